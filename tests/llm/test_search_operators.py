"""Near-duplicates, nearest neighbours, HTML extraction and the pipeline against plain versions, and on odd inputs."""

from __future__ import annotations

import itertools
import os
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from mediastrata.llm import html_extract, simhash, vptree
from tests.llm.plain import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@settings(max_examples=60, deadline=None)
@given(st.text("abAB é\x85\n\t", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & 2**64 - 1 == plain_fingerprint(text)


def test_anchors_cover():
    x = np.random.default_rng(1).integers(0, 2**32, 4000, dtype=np.uint32)
    row, anchor, home = simhash.anchors(x)
    d = np.bitwise_count(anchor ^ x[row])
    assert d.max() <= 2 and d[home].max() <= 1 and sorted(row[home].tolist()) == list(range(len(x)))
    assert len(set(zip(row.tolist(), anchor.tolist(), strict=True))) == len(row)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    for k in range(200):
        mine = set(simhash.anchors(x[k : k + 1] ^ np.uint32(1 << k % 32))[1].tolist())
        assert homes[k] in mine


@pytest.mark.parametrize("crowd", [4096, 3])
def test_classes_equal_brute_force(spark, crowd):
    r = np.random.default_rng(2)
    fps = [int(x) for x in r.integers(0, 2**64, 60, dtype=np.uint64)]
    for f in fps[:20]:  # chains and crowds of near fingerprints
        at = f
        for _ in range(6):
            at ^= int(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 2).astype(np.uint64)))
            fps.append(at)
    rows = [(k, f) for k, f in enumerate(fps)] + [(500, fps[3]), (-7, fps[70])]
    df = spark.createDataFrame([(k, f - 2**64 if f >> 63 else f) for k, f in rows], "doc_id long, fp long")
    edges = simhash.links(df.select("fp").distinct(), crowd)
    roots = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    least = {}
    for k, f in rows:
        f = f - 2**64 if f >> 63 else f
        root = roots.get(f, f)
        least[root] = min(least.get(root, k), k)
    got = [least[roots.get(f - 2**64 if f >> 63 else f, f - 2**64 if f >> 63 else f)] for _, f in rows]
    assert got == plain_components(rows)
    if crowd == 4096:
        found = {(r["fp"]): r["component_id"] for r in simhash.classes(df).collect()}
        assert [found[f - 2**64 if f >> 63 else f] for _, f in rows] == plain_components(rows)


def test_a_crowd_streams_past_its_homes():
    """Groups larger than what a task holds give links that connect the same fingerprints as whole groups do."""
    r = np.random.default_rng(8)
    fps = np.unique(r.integers(0, 2**7, 300).astype(np.int64) ^ (r.integers(0, 2, 300).astype(np.int64) << 40))
    home = np.zeros(len(fps), bool)
    home[:20] = True
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fps), np.int64)), pa.array(np.zeros(len(fps), np.int32)), pa.array(fps), pa.array(home)], names=["anchor", "salt", "fp", "home"])
    parts = [batch.slice(k, 16) for k in range(0, len(fps), 16)]

    def reach(batches):
        group = {int(f): int(f) for f in fps}

        def top(f):
            while group[f] != f:
                f = group[f]
            return f

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                assert (x ^ y).bit_count() <= 3
                group[top(x)] = top(y)
        return sorted(sorted(f for f in group if top(f) == t) for t in {top(f) for f in group})

    whole = reach(simhash._links(iter(parts)))
    held, simhash.HELD = simhash.HELD, 50
    try:
        assert reach(simhash._links(iter(parts))) == whole
    finally:
        simhash.HELD = held


def test_near_duplicates_odd(odd, empty):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    want = sorted(zip([str(i) for i, _ in rows], [f"{f:016x}" for _, f in rows], plain_components(rows), strict=True), key=str)
    got = sorted(((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == want
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({f for _, f in rows})
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


def _plain_nearest(vectors, k):
    usable = {i: np.array(v, float) / np.abs(np.array(v, float)).max() for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, a in usable.items():
        scored = [(-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), j) for j, b in usable.items() if j != i and len(a) == len(b)]
        out[i] = sorted((round(s, 12), j) for s, j in scored)[:k]
    return out


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = [(k, r.normal(size=8).tolist()) for k in range(400)]
    vectors += [(1000 + k, [1.0] * 8) for k in range(300)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] * 8), (2005, [float("inf")] * 8), (None, [1.0] * 8), (2006, [1.0, 2.0]), (2007, [1e200] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    sizes = vptree.SHARD_BYTES, vptree.BATCH_QUERIES
    vptree.SHARD_BYTES, vptree.BATCH_QUERIES = 8 * 8 * 150, 100
    try:
        rows = vptree.nearest(df.withColumn("shard", F.lit("x")).withColumn("n", F.lit(1)), df).collect()
    finally:
        vptree.SHARD_BYTES, vptree.BATCH_QUERIES = sizes
    got = {}
    for x in sorted(rows, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((round(-x["score"], 12), x["vec_id"]))
    want = {i: v for i, v in _plain_nearest(vectors, 5).items() if v}
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
    assert all(abs(a - b) < 1e-9 for i in want for (a, _), (b, _) in zip(got[i], want[i], strict=True))
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_equal_scores_go_by_the_smaller_id():
    """Among proportional vectors the five are those of brute force in doubles, whatever the rounding of chords."""
    r = np.random.default_rng(0)
    for _ in range(20):
        base = r.normal(size=(6, 8))
        v = np.concatenate([base[r.integers(0, 6, 60)] * r.integers(1, 5, (60, 1)), r.normal(size=(100, 8))])
        ids = r.permutation(len(v)).astype(np.int64)
        scaled = v / np.abs(v).max(axis=1, keepdims=True)
        length = np.linalg.norm(scaled, axis=1)
        query, found, _ = vptree.Search(v, ids, 5, 1.0, leaf=8)(v[:40], ids[:40])
        for j in range(40):
            score = np.einsum("ij,ij->i", np.repeat(scaled[j : j + 1], len(v), 0), scaled) / (length[j] * length)
            assert found[query == j].tolist() == [ids[x] for x in np.lexsort((ids, -score)) if x != j][:5]


def _recall(v, ids, factor, exact):
    search = vptree.Search(v, ids, 5, factor)
    query, found, _ = search(v[:200], ids[:200])
    return len(set(zip(query.tolist(), found.tolist(), strict=True)) & exact) / len(exact), search.compared


def test_factor_trades_recall_for_work():
    """Vectors near a few planes, where trees prune: factor 1 looks at fewer pairs than there are and finds all, larger ones at fewer still."""
    r = np.random.default_rng(6)
    v = r.normal(size=(4000, 3)) @ r.normal(size=(3, 16)) + 0.01 * r.normal(size=(4000, 16))
    ids, unit = np.arange(4000), v / np.linalg.norm(v, axis=1, keepdims=True)
    brute = np.argsort(-(unit[:200] @ unit.T) + 9 * np.eye(200, 4000), axis=1, kind="stable")[:, :5]
    exact = {(q, j) for q in range(200) for j in brute[q].tolist()}
    recall, compared = _recall(v, ids, 1.0, exact)
    assert recall == 1 and compared < 0.5 * 200 * 4000
    before = compared
    for factor in (1.5, 2.0):
        recall, compared = _recall(v, ids, factor, exact)
        assert recall >= 0.9 and compared < before
        before = compared


@here
def test_recall_of_the_factor_that_the_readme_names():
    """On the driver's embeddings nothing can be pruned up to factor 4; factor 6 still finds nine of ten."""
    df = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    v, ids = np.array(df["embedding"].to_pylist(), dtype=float), df["vec_id"].to_numpy()
    query, found, _ = vptree.Search(v, ids)(v[:200], ids[:200])
    exact = set(zip(query.tolist(), found.tolist(), strict=True))
    assert _recall(v, ids, 1.0, exact)[0] == 1 and _recall(v, ids, 6.0, exact)[0] >= 0.9


@pytest.fixture(scope="module")
def field():
    return html_extract.train()


def test_main_text(field):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header><nav><ul><li><a href="/a">Home</a></li></ul></nav></header>
    <div class="cookie-notice">We use cookies.</div><article><h1>Big  &amp; small</h1><p>One <b>two</b>
    three&nbsp;four.<p>Second paragraph, with <a href="#">a link</a> inside it.</p><!-- no --><ul><li>First point.</li><li>Second point.</li></ul>
    <section class="comments"><div class="comment"><p>Nice post.</p></div></section></article><footer>&copy; site</footer></body></html>"""
    assert html_extract.main_text(page, field) == "Big & small\n\nOne two three four.\n\nSecond paragraph, with a link inside it.\n\nFirst point.\n\nSecond point."
    assert html_extract.main_text("", field) == "" and html_extract.main_text("<p", field) == "" and html_extract.main_text("<nav><a>x</a></nav>", field) == ""


def test_held_out_blocks(field):
    pairs = [(a, b) for found, labels in html_extract.labelled_pages(60, seed=99) for a, b in zip(field.decode(html_extract.features(found)), labels, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98


def test_viterbi_is_the_best_path(field):
    for found, _ in html_extract.labelled_pages(12, seed=5):
        f = html_extract.features(found)[:9]
        s = field.scores(f)
        total = lambda p: sum(s[k][x] for k, x in enumerate(p)) + sum(field.pairs[a][b] for a, b in zip(p, p[1:], strict=False))
        best = max(total(p) for p in itertools.product((0, 1), repeat=len(f)))
        assert abs(total(field.decode(f)) - best) < 1e-9


def test_marginals_are_sums_over_all_paths():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        s, pairs = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        p, both = html_extract.marginals(s, pairs)
        weights = {x: np.exp(sum(s[k][i] for k, i in enumerate(x)) + sum(pairs[a][b] for a, b in zip(x, x[1:], strict=False))) for x in itertools.product((0, 1), repeat=n)}
        whole = sum(weights.values())
        for k in range(n):
            assert abs(p[k][1] - sum(w for x, w in weights.items() if x[k]) / whole) < 1e-9
        for a in (0, 1):
            for b in (0, 1):
                expected = sum(w * sum(x[k] == a and x[k + 1] == b for k in range(n - 1)) for x, w in weights.items()) / whole
                assert abs(both[a][b] - expected) < 1e-9


def _random_tree(r, depth=0):
    """(html, parts): parts are texts, and None where a block begins or ends."""
    out, parts = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["text", "text", "inline", "block", "comment", "void", "script", "hidden"]) if depth < 5 else "text"
        if kind == "text":
            t = r.choice(["one two", " x  y ", "a &amp; b", "\n", "5 < 6", "it's", "caf&eacute;", "&#65;&#x42;"])
            out.append(t)
            parts.append(t.replace("&amp;", "&").replace("&eacute;", "é").replace("&#65;&#x42;", "AB"))
        elif kind in ("inline", "block"):
            tag = r.choice(["b", "span", "em", "code"] if kind == "inline" else ["div", "section", "blockquote", "article"])
            inner, own = _random_tree(r, depth + 1)
            out.append(f"<{tag}{r.choice(['', ' title=\"a hidden gem\"', ' data-x=hidden', ' class=\'x > y\' id=q'])}>{inner}</{tag.upper() if r.random() < 0.2 else tag}>")
            parts += own if kind == "inline" else [None, *own, None]
        elif kind == "comment":
            out.append("<!-- <p>no</p> -->")
        elif kind == "void":
            out.append("<br>")
            parts.append(" ")
        elif kind == "script":
            out.append("<script>if (a < b) { '</p>' }</script>")
            parts.append(None)
        else:
            out.append(r.choice(["<div hidden>no</div>", "<div aria-hidden='TRUE'>no<b>no</b></div>", '<div style="color:red; display : none">no</div>']))
            parts.append(None)
    return "".join(out), parts


def test_blocks_are_those_of_the_tree():
    r = random.Random(3)
    for _ in range(400):
        page, parts = _random_tree(r)
        want, run = [], []
        for p in [*parts, None]:
            if p is not None:
                run.append(p)
            else:
                want.append(" ".join("".join(run).split()))
                run = []
        assert [b.text for b in html_extract.blocks(page)] == [w for w in want if w], page


def test_long_pages_take_time_that_grows_with_their_length():
    n = 50_000
    pages = [
        "<a " * n * 7, "<div>" * n + "x" + "</div>" * n, "<div>" * n + "</span></b>" * n, "<b>" * n + "<hr>" * n, '<p a="' * n, "</script" * n, "<noscript>" * n, "<!--" * n, "<" * n * 5,
        "".join(f"<x{k} class='c{k}'>" for k in range(n)), "<b><div>" + "<i>" * n + "</b>" * n, "<p " + "a " * n + ">", "&#" + "9" * n + ";",
    ]
    for page in pages:
        start = time.perf_counter()
        html_extract.blocks(page, frozenset(("ad",)))
        assert time.perf_counter() - start < 8, page[:20]


def test_nothing_in_an_article_is_dropped(field):
    say = lambda inside, a="": html_extract.main_text(f"<article{a}><h1>A title</h1><p>It says {inside} to us.</p></article>", field)
    assert say("much", ' title="a hidden gem"') == say("much", " data-x=hidden") == "A title\n\nIt says much to us."
    assert say("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>") == "A title\n\nIt says x=2 to us."
    assert html_extract.main_text("<article><p>First a line.</p><xmp>if a < b & c</xmp><p>Then a line.</p></article>", field) == "First a line.\n\nif a < b & c\n\nThen a line."
    assert say("much", " hidden") == say("much", " aria-hidden=true") == ""
    assert say("&#" + "9" * 5000 + ";") == "A title\n\nIt says \ufffd to us."


def test_odd_pages(spark, field):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text"), (3, "u", "<" * 2000), (4, "u", "<p a='" + "x" * 5000), (5, "u", "<article><p>" + "long " * 30_000 + "end.</p></article>"), (5, "u", "<script>never ends")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(pages, field, "html", {"page_id": F.col("page_id"), "url": F.col("url")}).collect()
    assert len(got) == len(rows) and all(len(r["text"]) == r["n_chars"] for r in got)
    assert max(r["n_chars"] for r in got) == 5 * 30_000 + 4
    assert html_extract.extract(pages.limit(0), field).count() == 0


@here
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, n = docs, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, SF).cache()
        if k < 3:
            assert out.columns == docs.columns and 0 < out.count() <= n
            assert out.select("doc_id").subtract(seen.select("doc_id")).count() == 0
            seen, n = out, out.count()
    assert n < docs.count()
    pieces = {(r["doc_id"], r["start"]) for r in out.collect()}
    assert {d for d, _ in pieces} == {r["doc_id"] for r in seen.collect()}
    assert {(r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, SF).collect()} == pieces


def test_pipeline_stages_odd(spark, odd, empty):
    """Each stage keeps rows of its input as they are, whatever their columns' names; none comes from an empty table."""
    odd = odd.withColumns({c: F.lit(k) for k, c in enumerate(("host", "failed", "row", "its", "salt", "__fp", "__kept", "value", "root", "id", "own", "component_id"))})
    good = [(100 + k, " ".join(f"w{(k * 7 + j) % 97}" for j in range(14)), "en", "good", 1, None, None, None, None) for k in range(40)]
    odd = odd.union(spark.createDataFrame([(*g, *range(12)) for g in good], odd.schema))
    rows = [tuple(r) for r in odd.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name == "packing":
            assert sorted(str(r["doc_id"]) for r in out.where("start = 0").collect()) == sorted(str(r[0]) for r in rows)
            assert stage(spark, empty, SF).count() == 0
            continue
        assert out.columns == odd.columns and out.count() > 0
        assert all(tuple(r) in rows for r in out.collect())
        assert stage(spark, empty, SF).columns == empty.columns and stage(spark, empty, SF).count() == 0
