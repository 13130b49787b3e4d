"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and word beginnings that mark toxic texts), the trees and the calibration are fitted on a
bounded sample of labelled rows; what is broadcast has a size that the parameters fix. Every whole text is scored
by one map over the input, without a shuffle.

Defined cases: a null text counts as empty; an empty text gets the score of its (zero) features; without labelled
rows, or with labels of one kind only, every score is the share of toxic labels (0 where there are none); several
labels of one document count as toxic if any does; null labels and null ids are not learned from; repeated rows
are each returned; an empty table gives no rows; a text of any length is scored whole, in time that grows with its
length; the filter passes other columns through, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediastrata.llm.common import Transform, hash_bound, id_bucket, materialize, slices, table, text_list, whole_row, with_columns

#: The classifier learns from about this many labelled rows: those whose ids have the smallest hashes.
TRAINING_ROWS = 12_000
THRESHOLD = 0.7
#: A lexicon entry stands in so many toxic sample texts at least, and raises the log odds by so much.
LEXICON_TEXTS, LEXICON_LOG_ODDS, LEXICON_SIZE = 8, 2.0, 4000
PREFIX = 5
#: Texts of either label that the calibration needs for itself; with fewer it sees the trees' own rows.
LEAST_HELD = 20
#: How many words from a lexicon word a second-person pronoun counts as near.
NEAR = 6
# Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros os".split()
)
# Characters that commonly stand for letters.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

_WORDS = re.compile(r"[^\W\d_]+")
#: A letter, then digits or symbols, then a letter, in one run without blanks.
#: Each run is read once: matches begin where a run of letters or of marks does, and nothing is given back.
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*._-]++[^\W\d_]++)++|(?<![0-9@$!|])[0-9@$!|]++[^\W\d_]++")
_RUNS = re.compile(r"([^\W\d_])\1\1")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
FEATURES = (
    "word_density", "word_count", "word_weight", "prefix_density", "prefix_count", "prefix_weight", "second_person_near", "second_person_density",
    "hidden_density", "hidden_count", "mixed_density", "run_density", "capital_share", "shouted_density", "exclaim_density", "punctuation_share", "log_words",
)


@dataclass
class Trees:
    """Boosted regression trees of a fixed depth on the log odds; node arrays are in heap order."""

    base: float = 0.0
    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3, bins: int = 32, ridge: float = 2.0, least: int = 8) -> Trees:
        """Histogram boosting with second-order gains on the logistic loss."""
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        model = cls(base=math.log(p / (1 - p)), depth=depth)
        cuts = [np.unique(np.quantile(x[:, f][x[:, f] != 0] if (x[:, f] != 0).any() else x[:, f], np.linspace(0, 1, bins - 1))) for f in range(x.shape[1])]
        cuts = [np.unique(np.concatenate(([0.0], c))) for c in cuts]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(x), model.base)
        inner = 2**depth - 1
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            grad, hess = q - y, q * (1 - q)
            feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                local = node - first
                best = np.full(width, 1e-6)
                for f, c in enumerate(cuts):
                    k = len(c) + 1
                    key = local * k + binned[:, f]
                    g, h, n = (np.bincount(key, w, width * k).reshape(width, k).cumsum(axis=1) for w in (grad, hess, np.ones(len(x))))
                    gr, hr, nr = g[:, -1:] - g, h[:, -1:] - h, n[:, -1:] - n
                    gain = g**2 / (h + ridge) + gr**2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    gain[(n < least) | (nr < least)] = -1
                    at = gain[:, : len(c)].argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for j in np.flatnonzero(top > best):
                        best[j], feature[first + j], cut[first + j] = top[j], f, c[at[j]]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - inner
            value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
            model.feature.append(feature)
            model.cut.append(cut)
            model.value.append(value)
            margin += value[leaf]
        return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the knots of a non-decreasing function from margin to the share of y."""
    blocks: list[list[float]] = []  # sum of y, count, least margin, largest margin
    order = np.argsort(margin, kind="stable")
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    return np.array([m for b in blocks for m in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def _near(hits: list[int], second: list[int]) -> int:
    """How many of the hits have one of second (both are ascending) within NEAR places."""
    if not hits or not second:
        return 0
    at = np.array(hits)
    after = np.searchsorted(second, at)
    places = np.concatenate(([-NEAR - 1], second, [at[-1] + NEAR + 1]))
    return int(((at - places[after] <= NEAR) | (places[after + 1] - at <= NEAR)).sum())


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    share: float = 0.0

    def features(self, text: str) -> list[float]:
        raw = _WORDS.findall(text)
        words = list(map(str.lower, raw))
        n, chars = max(1, len(words)), max(1, len(text))
        lexicon, prefixes = self.words, self.prefixes
        hits = [i for i, w in enumerate(words) if w in lexicon]
        starts = [w[:PREFIX] for w in words]
        begun = [s for s in starts if s in prefixes]
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = _near(hits, second)
        mixed = _MIXED.findall(text)
        hidden = 0
        for m in mixed:
            plain = m.lower().translate(LOOKALIKE)
            for w in {"".join(_WORDS.findall(plain)), re.sub(r"[^\w]|_", "", m.lower().replace("*", "").translate(LOOKALIKE))}:
                hidden += w in lexicon or w[:PREFIX] in prefixes
        capitals = sum(map(str.isupper, "".join(w[0] for w in raw if len(w) > 1))) + 0.0
        marks = text.count("!") + text.count("?")
        return [
            100 * len(hits) / n, math.log1p(len(hits)), max((lexicon[words[i]] for i in hits), default=0.0),
            100 * len(begun) / n, math.log1p(len(begun)), max((prefixes[s] for s in begun), default=0.0), near / n * 100, 100 * len(second) / n,
            100 * hidden / n, math.log1p(hidden), 100 * len(mixed) / n, 100 * len(_RUNS.findall(text)) / n if _RUNS.search(text) else 0.0, capitals / n,
            100 * len(_SHOUTED.findall(text)) / n, 100 * marks / chars, (marks + text.count(".") + text.count(",") + text.count("*")) / chars, math.log1p(len(words)),
        ]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        x = np.array([self.features(t) for t in texts])
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def _text_terms(text: str) -> tuple[int, set[str]]:
    """A min-hash of the text's word pairs, and its words and, after a '^', their beginnings."""
    words = list(map(str.lower, _WORDS.findall(text)))
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    return min((xxhash.xxh64_intdigest(p) for p in pairs), default=0) >> 1, {*words, *("^" + w[:PREFIX] for w in words if len(w) > PREFIX)}


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, n) over a partition's texts."""
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for batch in (part for whole in batches for part in slices(whole)):
        for toxic, text in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), strict=True):
            counts[toxic > 0].update(_text_terms(text)[1])
    for toxic in (0, 1):
        terms = list(counts[toxic])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic] * len(terms), pa.int32()), pa.array([counts[toxic][t] for t in terms], pa.int64())], names=["term", "toxic", "n"])


def _min_hashes() -> Transform:
    return lambda texts: [pa.array([_text_terms(t)[0] for t in text_list(texts)], pa.int64())]


def train(rows: DataFrame) -> Model:
    """Fits on rows (doc_id, text, toxic); rows are a bounded sample already, see sample()."""
    kept = {"toxic": F.col("toxic").cast("int"), "text": F.coalesce("text", F.lit(""))}
    rows = materialize(with_columns(rows, F.col("text"), kept, "h bigint", _min_hashes), "toxicity-sample")
    # Near copies would make every one of their words a mark of their label: for the lexicon, texts with the same min-hash count once.
    once = rows.groupBy("h", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    totals = {r["toxic"]: r["n"] for r in once.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    if not positive or not negative:
        return Model(share=float(bool(positive)))
    terms = once.mapInArrow(_terms, "term string, toxic int, n bigint").groupBy("term").agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("q"))
    weight = F.log((F.col("p") + 0.5) / (positive + 1)) - F.log((F.col("q") + 0.5) / (negative + 1))
    least = max(2, min(LEXICON_TEXTS, positive // 20))
    lexicon = terms.where(F.col("p") >= least).select("term", weight.alias("w")).where(F.col("w") >= LEXICON_LOG_ODDS).orderBy(F.desc("w"), "term").limit(LEXICON_SIZE).collect()
    model = Model(words={r["term"]: r["w"] for r in lexicon if r["term"][0] != "^"}, prefixes={r["term"][1:]: r["w"] for r in lexicon if r["term"][0] == "^"})

    def features() -> Transform:
        return lambda texts: [pa.array([model.features(t) for t in text_list(texts)], pa.list_(pa.float64()))]

    found = with_columns(rows, F.col("text"), {"toxic": F.col("toxic"), "h": F.col("h")}, "x array<double>", features).toArrow()  # a sample's rows of numbers
    order = np.lexsort((found["toxic"].to_numpy(), found["h"].to_numpy()))
    x = np.array(found["x"].to_pylist())[order]
    y = (found["toxic"].to_numpy()[order] > 0).astype(float)
    held = (found["h"].to_numpy()[order] % 10) < 3  # copies are on one side
    if min(y[held].sum(), (1 - y[held]).sum()) < LEAST_HELD or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)  # too few to calibrate on alone
    model.trees = Trees.fit(x[~held], y[~held])
    model.knots = isotonic(model.trees.margin(x[held] if held.any() else x), y[held] if held.any() else y)
    model.share = float(y.mean())
    return model


def sample(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """About max_rows labelled rows (doc_id, text, toxic), by the smallest hashes of their ids; of an id's texts each counts once.

    Where ids stand before many different texts, a second choice by the texts' hashes bounds the rows themselves.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bound = hash_bound(known, "doc_id", max_rows)
    chosen = known.where(F.xxhash64(F.col("doc_id").cast("string")) <= F.lit(bound if bound is not None else -(2**63)))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: max_rows pairs of numbers
    once = found.withColumn("own", F.xxhash64("doc_id", "text")).groupBy("doc_id", "own").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    rows = materialize(once, "toxicity-labelled")
    if rows.count() <= 2 * max_rows:
        return rows.drop("own")
    return rows.where(F.xxhash64(F.col("own").cast("string")) <= F.lit(hash_bound(rows, "own", max_rows))).drop("own")


def scored(docs: DataFrame, model: Model, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """The columns in keep and the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_SIZE entries and 60 small trees

    def scorer() -> Transform:
        m = shared.value
        return lambda texts: [pa.array(m.score(text_list(texts)), pa.float64())]

    return with_columns(docs, F.col(f"`{text_col}`"), keep, "score double", scorer)


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learns from rows of labels with crc32(doc_id) mod 3 other than 1."""
    return train(sample(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 3) != 1))


def filter_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the columns of docs."""
    out = scored(docs, model, "text", {"row": whole_row(docs)})
    return out.where(F.col("score") < threshold).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False))
    out = scored(docs, fit(spark, docs, sf_dir), "text", {"doc_id": F.col("doc_id"), "held_out": held_out})
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
