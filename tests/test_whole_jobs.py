"""Whole texts and whole tables where the smallest tables can't show a cut."""

from __future__ import annotations

import bisect
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from mediastrata.operators import merkle, policy, ranges
from mediastrata.plans import registry


def test_roots_by_levels_cover_texts_of_over_512_chunks(spark, tmp_path):
    texts = {1: "".join(f"{k:08d}" for k in range(16_500)), 2: "short", 3: "x" * 131_072}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = lambda t: [hashlib.sha256(t[i : i + registry.CAP].encode()).digest() for i in range(0, len(t), registry.CAP)]
    want = {k: merkle.tree(cut(t), "sha256")[-1][0].hex() for k, t in texts.items()}
    found = registry.queries()["merkle_roots_by_levels"](spark, str(tmp_path))
    assert {r["doc_id"]: r["merkle_root"] for r in found.collect()} == want


def test_trees_of_any_size(spark):
    """Blocks of four leaves stand for blocks of thousands: roots and proofs are those of the whole tree, whatever its depth."""
    sizes = (1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 70, 257)
    rows = [(n, 3 * i, f"{n * 1000 + i:064x}") for n in sizes for i in range(n)]
    hashed = spark.createDataFrame(rows, "doc_id bigint, chunk_index bigint, hash string")
    want = {n: merkle.tree([bytes.fromhex(h) for k, _, h in rows if k == n], "sha256")[-1][0].hex() for n in sizes}
    in_rows = {(r["doc_id"], r["pos"]): (r["hash"], r["path"]) for r in merkle.proofs(hashed, ["doc_id"]).collect()}
    levels, merkle.BLOCK_LEVELS = merkle.BLOCK_LEVELS, 2
    try:
        assert merkle.root_by_levels(hashed.limit(0), ["doc_id"]).collect() == []
        assert {r["doc_id"]: r["merkle_root"] for r in merkle.root_by_levels(hashed, ["doc_id"]).collect()} == want
        assert {r["doc_id"]: r["merkle_root"] for r in merkle.root_by_levels(hashed, ["doc_id"], algorithm="blake3").collect()} != want
        assert {(r["doc_id"], r["pos"]): (r["hash"], r["path"]) for r in merkle.proofs_by_levels(hashed, ["doc_id"]).collect()} == in_rows
        top = merkle.node_levels(hashed.where("doc_id = 257"), ["doc_id"])
        assert len(top) == 10 and top[-1].first()["hash"] == want[257]
    finally:
        merkle.BLOCK_LEVELS = levels
    assert {r["doc_id"]: r["merkle_root"] for r in merkle.roots(hashed, ["doc_id"]).collect()} == want
    assert {r["doc_id"]: r["merkle_root"] for r in merkle.root_by_levels(hashed, ["doc_id"]).collect()} == want


def test_a_tree_beyond_a_million_leaves(spark):
    n = 2**20 + 1
    hashed = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("chunk_index"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    want = merkle.tree([hashlib.sha256(str(i).encode()).digest() for i in range(n)], "sha256")[-1][0].hex()
    assert merkle.root_by_levels(hashed, ["doc_id"]).first()["merkle_root"] == want


def test_many_requests_on_one_long_track(spark):
    """As-of joins in small buckets equal a search in the sorted track, ties and gaps included."""
    r = random.Random(5)
    places = sorted(r.choices(range(0, 60_000, 3), k=20_000))
    chunks = spark.createDataFrame([(0, k, None if k % 11 == 4 else p, k % 97 == 0) for k, p in enumerate(places)], "track long, chunk_index long, pts long, is_idr boolean")
    asked = [(q, 0, r.uniform(0, 70_000), r.uniform(0, 70_000), r.randrange(21_000), r.randrange(21_000), 1, 1) for q in range(10_000)]
    requests = spark.createDataFrame(asked, "request_id int, track long, start_time double, end_time double, first_chunk long, end_chunk long, timebase_num long, timebase_den long")
    timed = [(p, k) for k, p in enumerate(places) if k % 11 != 4]
    by_index = [(k, p) for p, k in timed]
    size, ranges.BUCKET_CHUNKS = ranges.BUCKET_CHUNKS, 100
    try:
        first = {x["request_id"]: (x["first_chunk"], x["end_chunk"]) for x in ranges.time_to_chunks(requests, chunks, ["track"]).collect()}
        back = {x["request_id"]: (x["start_time"], x["end_time"]) for x in ranges.chunks_to_time(requests, chunks, ["track"]).collect()}
        snap = {x["request_id"]: x["idr_chunk"] for x in ranges.snap_to_idr(requests, chunks, ["track"]).collect()}
    finally:
        ranges.BUCKET_CHUNKS = size
    for q, _, s, e, f, stop, _, _ in asked:
        i, j = bisect.bisect_right(timed, (math.floor(s), 10**9)) - 1, bisect.bisect_left(timed, (math.ceil(e), -1))
        a, b = timed[i][1] if i >= 0 else timed[0][1], timed[j][1] if j < len(timed) else timed[-1][1] + 1
        assert first[q] == ((a, b) if a < b else (None, None))
        i, j, last = bisect.bisect_left(by_index, (f, -1)), bisect.bisect_left(by_index, (stop, -1)), bisect.bisect_left(by_index, (stop, -1)) - 1
        inside = by_index[last][1] + 1 if last >= 0 and by_index[last][0] >= f else None
        end = by_index[j][1] if j < len(by_index) else inside
        assert back[q] == ((by_index[i][1], end) if f < stop and i < len(by_index) and end is not None else (None, None))
        assert snap[q] == min(f, len(places) - 1) // 97 * 97


def test_every_chunk_of_every_text_is_read(spark, tmp_path):
    texts = {1: "Größe é " * 200, 2: "abc", 3: "", 4: "x" * 512, 5: "plain ASCII text " * 40}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["chunk_reads"](spark, str(tmp_path)).collect()
    assert all(r["offset"] == r["chunk_index"] * registry.CAP and r["size"] * 2 == len(r["chunk"]) for r in found)
    for k, text in texts.items():
        parts = sorted((r["chunk_index"], r["chunk"]) for r in found if r["doc_id"] == k)
        assert bytes.fromhex("".join(c for _, c in parts)) == text.encode()


def test_ancestry_has_no_limit_of_levels_or_rows(spark):
    n, limit = 150, "spark.sql.cteRecursionRowLimit"
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(0, None), (1000, 140), (1000, 3)], "child bigint, parent bigint")
    spark.conf.set(limit, "100")
    try:
        got = sorted(tuple(r) for r in policy.ancestry(edges).collect())
    finally:
        spark.conf.unset(limit)
    up = lambda child, first, d: [(child, a, d + first - a) for a in range(first, -1, -1)]
    assert got == sorted([x for i in range(1, n) for x in up(i, i - 1, 1)] + up(1000, 140, 1) + up(1000, 3, 1))


def test_ancestry_of_a_loop_is_an_error(spark):
    with pytest.raises(ValueError, match="own ancestor"):
        policy.ancestry(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child bigint, parent bigint"))
