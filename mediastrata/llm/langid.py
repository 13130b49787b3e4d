"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting is one aggregation over a bounded sample of the labelled texts; the log-probability matrix (buckets x
languages) has a size that the parameters fix, and is broadcast. Scoring maps every whole text to its hashed
n-grams, a batch at a time, and multiplies that sparse batch with the matrix in numpy.

Defined cases: a text that is null or has no letter gives ``und`` with score 0; so does every text where nothing
could be learned; among equally likely languages the first by name wins; a null id counts as not held out and is
never learned from; repeated rows are each returned; an empty table gives no rows; a text of any length is one
row of the sparse batch, in time and memory that grow with its length; columns in keep may have any names but
lang_pred and score, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediastrata.llm.common import Transform, hash_bound, id_bucket, slices, table, text_list, with_columns

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: The classifier learns from about this many rows: those whose ids have the smallest hashes.
TRAINING_ROWS = 20_000
#: Pseudo-count of every n-gram.
ALPHA = 0.1

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's n-grams as a sparse matrix: buckets of all n-grams, where each text's begin, and which texts have a letter.

    Letters are lower-cased and each run of anything else counts as one space. The bucket BUCKETS stands for no n-gram.
    """
    parts = [np.frombuffer(("\0" + t.lower() + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1].astype(np.int64)
    points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    letter = _letters()[points]
    has = np.add.reduceat(letter, starts) > 0 if len(parts) else np.zeros(0, bool)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of non-letters, the first stays, as a space
    keep[starts] = True
    owner_starts = np.cumsum(keep)[starts] - 1
    points = np.where(letter, points, np.uint32(32))[keep]
    edge = np.zeros(len(points), bool)
    edge[owner_starts] = True
    out = np.full((len(points), len(ORDERS)), BUCKETS, dtype=np.int32)
    for column, n in enumerate(ORDERS):
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 0x9E3779B1 * (n + 1) & 0xFFFFFFFF, dtype=np.uint32)
        crosses = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ points[k : k + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            if k:
                crosses |= edge[k : k + m]
        out[:m, column] = np.where(crosses, BUCKETS, (h & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out, owner_starts, has


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    #: (BUCKETS + 1) x languages; the last row is zero.
    log_prob: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, starts, has = hashed_ngrams(texts)
        scores = np.zeros((len(texts), len(self.languages)))
        for column in range(grams.shape[1]):
            scores += np.add.reduceat(self.log_prob[grams[:, column]], starts, axis=0, dtype=np.float64)
        scores += self.log_prior
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, p.max(axis=1), 0.0)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition of training rows."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in (part for whole in batches for part in slices(whole)):
        langs, texts = batch.column(0).to_pylist(), text_list(batch.column(1))
        grams, starts, _ = hashed_ngrams(texts)
        ends = [*starts[1:], len(grams)]
        for lang, a, b in zip(langs, starts, ends, strict=True):
            counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            counts[lang] += np.bincount(grams[a:b].ravel(), minlength=BUCKETS + 1) if b - a > BUCKETS // 8 else _sparse(grams[a:b])
            docs[lang] = docs.get(lang, 0) + 1
    for lang, c in counts.items():
        c[BUCKETS] = docs[lang]  # the bucket of no n-gram carries the number of texts
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])


def _sparse(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS + 1, np.int64)
    at, n = np.unique(grams, return_counts=True)
    out[at] = n
    return out


def train(rows: DataFrame, text_col: str, lang_col: str, sample_by: str, max_rows: int = TRAINING_ROWS) -> Model:
    """Learns from about max_rows of the rows that have a language."""
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(sample_by).isNotNull())
    bound = hash_bound(labelled, sample_by, max_rows)
    if bound is None:
        return Model([], np.zeros(0), np.zeros((BUCKETS + 1, 0)))
    sample = labelled.where(F.xxhash64(F.col(sample_by).cast("string")) <= F.lit(bound)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = sample.mapInArrow(_bucket_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted["lang"].to_pylist()))
    at = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((BUCKETS + 1, len(languages)))
    counts[counted["bucket"].to_numpy(), [at[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    docs, grams = counts[BUCKETS], counts[:BUCKETS] + ALPHA
    log_prob = np.zeros((BUCKETS + 1, len(languages)), dtype=np.float32)
    log_prob[:BUCKETS] = np.log(grams / grams.sum(axis=0))
    return Model(languages, np.log(docs / docs.sum()), log_prob)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep, and lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + 1) x languages floats, whatever the input

    def scorer() -> Transform:
        m = shared.value

        def score(texts: pa.Array) -> list[pa.Array]:
            lang, p = m.predict(text_list(texts))
            return [pa.array(lang, pa.string()), pa.array(p, pa.float64())]

        return score

    return with_columns(docs, F.col(f"`{text_col}`"), keep or {}, "lang_pred string, score double", scorer)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows with crc32(doc_id) mod 4 = 2 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out), "text", "lang", "doc_id")
    return identify(docs, model, "text", {"doc_id": F.col("doc_id"), "held_out": held_out})
