"""Quality rules, license scans, language ID and toxicity against plain versions, and on odd documents."""

from __future__ import annotations

import itertools
import math
import os
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mediastrata.llm import langid, licenses, quality, toxicity
from mediastrata.llm.common import id_bucket
from tests.llm.plain import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def _plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd):
    texts = [r["text"] for r in odd.select("text").collect()] + ["a b c d e f a b c d e", "x\nx\n\n \nx", "\x85 \xa0a", "a b c d e a b c d e a b c d e f g", "#*$ %&|<>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in df.select("k", quality.measures("text").alias("m")).select("k", "m.*").collect():
        assert tuple(r)[1:] == _plain_measures(texts[r["k"]]), texts[r["k"]]


def test_quality_hosts(spark, odd, empty):
    good = " ".join(f"w{k}" for k in range(12))
    rows = [(k, good if k % 20 else "too short", f"good{k % 3}") for k in range(300)] + [(1000 + k, "too short" if k % 10 else good, "bad") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert not any(got[1000 + k] for k in range(300))
    assert all(got[k] == bool(k % 20) for k in range(300))
    assert {r["doc_id"] for r in quality.filter_documents(docs).collect()} == {k for k, v in got.items() if v}
    before = quality.BROADCAST_HOSTS, quality.HOT_SHARE
    try:
        for share in (1e-4, 0.3, 2.0):  # every host is hot, the bad one is, none is
            quality.BROADCAST_HOSTS, quality.HOT_SHARE = 0, share
            assert {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()} == got
    finally:
        quality.BROADCAST_HOSTS, quality.HOT_SHARE = before
    assert quality.quality_rules(odd).count() == odd.count()
    assert quality.filter_documents(odd).columns == odd.columns
    assert quality.quality_rules(empty).count() == quality.filter_documents(empty).count() == 0


def test_quality_flat_rates(spark):
    docs = spark.createDataFrame([(k, "too short", f"h{k % 2}") for k in range(10)], "doc_id long, text string, source string")
    assert not any(r["kept"] for r in quality.quality_rules(docs).collect())


@here
@pytest.mark.parametrize(("query", "sql"), [(quality.op8_quality_rules, quality.SQL), (licenses.op6_license_scan, licenses.SQL)])
def test_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = query(spark, SF)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in found.fetchall())


def test_licenses(spark, odd, empty):
    whole = dict(licenses.TEMPLATES)
    filler = " ".join(f"filler{k}" for k in range(40))
    edited = whole["mit-permission"].replace("obtaining", "getting")
    texts = {
        1: f"{filler} {whole['mit-permission']} {filler}", 2: f"{filler} {edited}", 3: whole["apache-2.0"].upper(), 4: " ".join(whole["mit-permission"].split()[:20]), 5: filler, 6: f"{whole['mit']} {filler} {whole['mit']}", 7: "all\nrights,\nreserved",
    }
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    by = {k: sorted((r["license"], r["first_word"]) for r in got if r["doc_id"] == k) for k in texts}
    assert by[1] == [("mit-permission", 40)] and [x for x, _ in by[2]] == ["mit-permission"] and by[3] == [("apache-2.0", 0)]
    assert by[4] == by[5] == [] and by[6] == [("mit", 0), ("mit", 45)] and by[7] == [("all-rights-reserved", 0)]
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0 and licenses.scan(odd, ()).count() == 0
    assert "Python" not in licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()


def _plain_passages(words, template, n, containment=0.8):
    """Every window as long as the template that begins with one of its shingles, one by one."""
    grams = lambda w: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    own, g = grams(template), grams(words)
    m, distinct = len(own), set(own)
    starts = [i for i, x in enumerate(g) if x in distinct and len(distinct & set(g[i : i + m])) / len(distinct) >= containment]
    return [i for k, i in enumerate(starts) if k == 0 or i - starts[k - 1] >= m]


def test_licenses_of_a_few_hundred_templates(spark):
    """Edited copies of templates of every class of length: retrieval by bands loses no more than one in a thousand passages."""
    r = np.random.default_rng(9)
    word = lambda: f"w{r.integers(400)}"
    lengths = [*range(1, 60), *r.integers(60, 700, 190).tolist()]
    templates = tuple((f"t{k}", " ".join([f"only{k}", *(word() for _ in range(n))])) for k, n in enumerate(lengths))
    docs = []
    for k, (_, text) in enumerate(templates):
        for copies in range(2):
            w = text.split()
            for _ in range(int(r.integers(0, 1 + len(w) // 25))):
                at = int(r.integers(len(w)))
                if r.random() < 0.5:
                    w[at] = "changed"
                else:
                    w.insert(at, "added")
            docs.append((2 * k + copies, [word() for _ in range(int(r.integers(0, 60)))] + w + [word() for _ in range(int(r.integers(0, 60)))]))
    got = licenses.scan(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), templates).collect()
    found = {(x["doc_id"], x["license"], x["first_word"]) for x in got}
    want = set()
    for k, w in docs:
        for name, text in templates:
            t = text.split()
            if set(t) <= set(w) or name == f"t{k // 2}" or t[0] in w:
                want |= {(k, name, i) for i in _plain_passages(w, t, min(5, len(t)))}
    assert found <= want and len(want) > 400
    assert len(want - found) <= 0.001 * len(want)


def test_language_model_is_naive_bayes(spark):
    """Scores are those of counts made one n-gram at a time."""
    rows = [(k, text, lang) for k, (text, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the end of the day", "en"), ("das ende des tages", "de"), ("ein", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang", "doc_id")
    assert model.languages == ["de", "en"]
    counts = np.zeros((langid.BUCKETS, 2))
    for _, text, lang in rows[:4]:
        grams, _, _ = langid.hashed_ngrams([text])
        for g in grams.ravel():
            if g < langid.BUCKETS:
                counts[g, model.languages.index(lang)] += 1
    log_prob = np.log((counts + langid.ALPHA) / (counts + langid.ALPHA).sum(axis=0))
    text = "the hund"
    grams = [g for g in langid.hashed_ngrams([text])[0].ravel() if g < langid.BUCKETS]
    scores = np.log([0.5, 0.5]) + log_prob[grams].sum(axis=0)
    p = np.exp(scores - scores.max())
    pred, score = model.predict([text, "", "123"])
    assert pred == [model.languages[int(scores.argmax())], "und", "und"]
    assert abs(score[0] - p.max() / p.sum()) < 1e-4 and list(score[1:]) == [0, 0]


def _plain_ngrams(text):
    """Buckets of a text's n-grams, one character at a time."""
    points = []
    for c in "\0" + text.lower() + "\0":
        if c.isalpha():
            points.append(ord(c))
        elif not points or points[-1] != 32:
            points.append(32)
    out = []
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0x9E3779B1 * (n + 1) & 0xFFFFFFFF
            for p in points[i : i + n]:
                h = (h ^ p) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 13
            out.append(h % langid.BUCKETS)
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abÄß 1.\né日\0İ", max_size=20), min_size=1, max_size=5))
def test_ngrams(texts):
    grams, starts, has = langid.hashed_ngrams(texts)
    for text, a, b, ok in zip(texts, starts, [*starts[1:], len(grams)], has, strict=True):
        assert sorted(g for g in grams[a:b].ravel().tolist() if g < langid.BUCKETS) == _plain_ngrams(text)
        assert bool(ok) == any(c.isalpha() for c in text.lower())


def _plain_features(model, text):
    """The features by loops over words and pairs of words, and by the patterns as one would first write them."""
    letter = lambda c: c.isalnum() and not c.isdecimal()
    raw = "".join(c if letter(c) else " " for c in text).split(" ")
    raw = [w for w in raw if w]
    words = [w.lower() for w in raw]
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in model.words]
    begun = [w[: toxicity.PREFIX] for w in words if w[: toxicity.PREFIX] in model.prefixes]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(1 for i in hits if any(abs(i - j) <= toxicity.NEAR for j in second))
    mixed = re.findall(r"[^\W\d_]+(?:[0-9@$!|*._-]+[^\W\d_]+)+|[0-9@$!|]+[^\W\d_]+", text)
    hidden = 0
    for m in mixed:
        shown = m.lower().translate(toxicity.LOOKALIKE)
        forms = {"".join(c for c in shown if letter(c)), re.sub(r"[^\w]|_", "", m.lower().replace("*", "").translate(toxicity.LOOKALIKE))}
        hidden += sum(w in model.words or w[: toxicity.PREFIX] in model.prefixes for w in forms)
    marks = text.count("!") + text.count("?")
    shouted = re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text)
    runs = re.findall(r"([^\W\d_])\1\1", text)
    return [
        100 * len(hits) / n, math.log1p(len(hits)), max([model.words[words[i]] for i in hits], default=0.0), 100 * len(begun) / n, math.log1p(len(begun)), max([model.prefixes[b] for b in begun], default=0.0),
        100 * near / n, 100 * len(second) / n, 100 * hidden / n, math.log1p(hidden), 100 * len(mixed) / n, 100 * len(runs) / n, sum(w[0].isupper() for w in raw if len(w) > 1) / n,
        100 * len(shouted) / n, 100 * marks / chars, (marks + text.count(".") + text.count(",") + text.count("*")) / chars, math.log1p(len(words)),
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["you ", "idiot ", "1d10t", "i.d.i.o.t ", "fool", "f00l ", "AAA ", "hmm ", "!", "?", ". ", "é", "_x_", "$", "12 ", "you're ", "idi", "ot ", "\n", "ß"]), max_size=40).map("".join))
def test_features(text):
    model = toxicity.Model(words={"idiot": 3.0, "fool": 2.5}, prefixes={"idiot": 3.1})
    assert np.allclose(model.features(text), _plain_features(model, text))


def test_long_texts_take_time_that_grows_with_their_length():
    model = toxicity.Model(words={"idiot": 3.0}, prefixes={"idiot": 3.0})
    for text in ("a" * 10**6, "1" * 10**6, "you x idiot " * 10**5, "a." * 10**5 * 3, "A" * 10**6 + "b"):
        start = time.perf_counter()
        model.features(text)
        assert time.perf_counter() - start < 8, text[:12]


def test_lexicon(spark):
    """The entries and weights are those of counts over the texts, each once."""
    r = np.random.default_rng(2)
    name = lambda x: "word" + chr(97 + x // 26) + chr(97 + x % 26)
    texts = [(" ".join(["vile"] * int(k % 3 != 0) + [name(x) for x in r.integers(0, 90, 12)]), int(k % 3 != 0)) for k in range(90)]
    rows = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.train(rows)
    letters = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", t)]
    terms = [({*letters(t), *("^" + w[:5] for w in letters(t) if len(w) > 5)}, y) for t, y in texts]
    kept = {}
    for k, (t, y) in enumerate(texts):  # of texts with the same least word pair, the first by its letters counts
        least = min(xxhash.xxh64_intdigest(f"{a} {b}") for a, b in itertools.pairwise(letters(t)))
        kept[least, y] = min(kept.get((least, y), (t, k)), (t, k))
    terms = [terms[k] for _, k in kept.values()]
    if len(terms) > 60:
        p, q = sum(y for _, y in terms), sum(1 - y for _, y in terms)
        want = {}
        for t in set().union(*(x for x, _ in terms)):
            a, b = sum(t in x for x, y in terms if y), sum(t in x for x, y in terms if not y)
            w = math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (q + 1))
            if a >= max(2, min(toxicity.LEXICON_TEXTS, p // 20)) and w >= toxicity.LEXICON_LOG_ODDS:
                want[t] = w
        got = {**model.words, **{"^" + k: w for k, w in model.prefixes.items()}}
        assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert "vile" in model.words


def test_a_sample_bounds_rows(spark):
    """An id before many texts, or many equal rows, doesn't make the sample long."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "same")] * 300 + [(3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    every = toxicity.sample(docs, labels, F.lit(True), 1000)
    assert sorted(r["doc_id"] for r in every.collect()) == [1] * 300 + [2, 3]
    few = toxicity.sample(docs, labels, F.lit(True), 20).count()
    assert 1 <= few <= 40


def _plain_quality(docs):
    """(doc_id, kept) by the measures one text at a time, and the hosts' rates with the beta prior of their moments."""
    measured = [(i, s or "", (m := _plain_measures(t))[0] < 10 or 100 * m[4] > 20 * m[0]) for i, t, s in docs]
    hosts = Counter(s for _, s, _ in measured)
    failed = Counter(s for _, s, f in measured if f)
    rates = [failed[h] / n for h, n in hosts.items()]
    mean = sum(rates) / len(rates)
    var = sum((x - mean) ** 2 for x in rates) / len(rates)
    strength = mean * (1 - mean) / var - 1 if var else 0
    strength = strength if strength > 0 else 10.0
    bad = {h for h, n in hosts.items() if (failed[h] + strength * mean) / (n + strength) > 0.5}
    return [i for i, s, f in measured if not f and s not in bad]


def _plain_score(model, text):
    """A walk down each tree, and a line between the calibration's knots."""
    x, margin = _plain_features(model, text), model.trees.base
    for feature, cut, value in zip(model.trees.feature, model.trees.cut, model.trees.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        margin += value[node - len(feature)]
    return float(np.interp(margin, *model.knots))


@here
def test_pipeline_equals_plain_stages(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = set(_plain_quality(docs))
    model = toxicity.fit(spark, spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(sorted(good))), SF)
    mild = [(i, t or "") for i, t, _ in docs if i in good and _plain_score(model, t or "") < toxicity.THRESHOLD]
    first = plain_components([(i, plain_fingerprint(t)) for i, t in mild])
    left = {i: t for (i, t), component in zip(mild, first, strict=True) if i == component}
    assert 0 < len(left) < len(mild) < len(docs)
    rows = corpus_pipeline.run(spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(left)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc, parts in pieces.items():
        ids = [*library.encode(left[doc], add_special_tokens=False).ids, 2]
        at = 0
        for start, length, n, crc in sorted(parts):
            assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_batches_do_not_leak():
    alone = [langid.hashed_ngrams([t])[0].tolist() for t in ("abc", "", "x y", "ééé")]
    grams, starts, _ = langid.hashed_ngrams(["abc", "", "x y", "ééé"])
    parts = [grams[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(grams)], strict=True)]
    assert parts == alone


@here
def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.97


def test_language_odd(spark, odd, empty):
    model = langid.train(odd, "text", "lang", "doc_id")
    got = langid.identify(odd, model, "text", {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 6)} == {"und"}
    none = langid.train(empty, "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_isotonic():
    knots, shares = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 5.0, 4.0]), np.array([0.0, 0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(shares) >= 0).all() and (np.diff(knots) >= 0).all()
    assert np.interp([0, 2.5, 9], knots, shares).tolist() == [0.0, 1 / 3, 1.0]


def test_trees_learn():
    r = np.random.default_rng(3)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.7)).astype(float)
    model = toxicity.Trees.fit(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


@here
def test_toxicity_accuracy(spark):
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((1, 1), 0) > 0.9 * (counts.get((1, 1), 0) + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.005 * counts[0, 0]


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 0), (5, 1), (5, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    usable = F.coalesce(id_bucket("doc_id", 3) >= 0, F.lit(False))
    model = toxicity.train(toxicity.sample(odd, labels, usable))
    got = toxicity.scored(odd, model, "text", {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.filter_documents(odd, model).columns == odd.columns
    unfit = toxicity.train(toxicity.sample(odd, labels.limit(0), usable))
    assert {r["score"] for r in toxicity.scored(odd, unfit, "text", {}).collect()} == {0.0}
    assert toxicity.scored(empty, model, "text", {}).count() == 0
