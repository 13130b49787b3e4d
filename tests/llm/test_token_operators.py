"""BPE, packing and token files against the library and plain versions, and on odd documents."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediastrata.llm import bpe, packing, tokenfile, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
ENCODERS = {p: tokens.PieceEncoder(p, cache=50) for p in (BYTES, WORDS)}
CODEC = bpe.ForcedBoundaryCodec(BYTES, cache=50)
ATOMS = [*" \n\t\r\x0b.,'!?aábBßzİΣσ9é日\xa0 ́’s_-<|>", "the", "ing", " and", "'ll", "word", "word,", "\nThe", "<|endoftext|>", "<|startoftext|>"]
TEXT = st.lists(st.sampled_from(ATOMS), max_size=30).map("".join)


def _ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_codec_equals_library(text):
    ids = _ids(BYTES, text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY[BYTES].decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_piece_encoder_equals_library(texts):
    for path, e in ENCODERS.items():
        assert [np.frombuffer(x, tokens.ID).tolist() for x in e.encode_batch(texts)] == [_ids(path, t) for t in texts]


def test_decode_of_broken_ids():
    ids = [i for i in range(300)]
    assert CODEC.decode(ids) == LIBRARY[BYTES].decode(ids, skip_special_tokens=False)


def test_forced_pairs_stand_in_no_token():
    for raw in CODEC.bytes_of[:50256]:
        assert not any(CODEC.forced[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False))
    assert CODEC.fragments("the\x00quick".encode()) != ["the\x00quick".encode()]


def test_round_trips(odd, empty):
    for r in bpe.round_trips(odd, BYTES, "text", {"doc_id": F.col("doc_id"), "text": F.coalesce("text", F.lit(""))}).collect():
        ids = _ids(BYTES, r["text"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert bpe.round_trips(empty, BYTES).count() == 0
    back = bpe.decoded(bpe.encoded(odd, BYTES, keep={"doc_id": F.col("doc_id")}), BYTES, keep={"doc_id": F.col("doc_id")})
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(odd, empty, capacity):
    rows = packing.pack(odd, WORDS, 2, capacity, with_ids=True).collect()
    own = {}
    for r in odd.collect():
        own.setdefault(r["doc_id"], []).append([*_ids(WORDS, r["text"] or ""), 2])
    for doc, copies in own.items():
        parts = sorted((r["start"], r["ids"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc)
        assert sorted(p[0] for p in parts) == sorted(s for c in copies for s in range(0, len(c), capacity))
        for start, ids, length, crc, n in parts:
            assert ids == copies[0][start : start + length] and n == len(copies[0]) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= capacity
    assert packing.pack(empty, WORDS, 2).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 100), st.integers(1, 60), min_size=1, max_size=25))
def test_patterns_hold_every_piece_once(histogram):
    bounds = packing.class_bounds(512, 4, 1.02)
    histogram = {c % len(bounds): n for c, n in histogram.items()}
    found = packing.patterns(histogram, bounds, 512, 4)
    total = dict.fromkeys(histogram, 0)
    for times, classes, counts in found:
        assert sum(bounds[c] * a for c, a in zip(classes, counts, strict=True)) <= 512
        for c, a in zip(classes, counts, strict=True):
            total[c] += times * int(a)
    assert total == histogram


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.floats(0.01, 1)), min_size=1, max_size=8), st.integers(10, 60))
def test_knapsack_is_feasible_and_good(items, capacity):
    sizes, values = np.array([s for s, _ in items]), np.array([v for _, v in items])
    value, counts = packing.knapsack(values, sizes, capacity)
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(best[c - s] + v for s, v in items if s <= c)])
    assert counts @ sizes <= capacity and abs(value - counts @ values) < 1e-9
    assert value >= 0.95 * best[capacity] - 1e-9


def test_program_reaches_the_bound():
    r = np.random.default_rng(5)
    bounds = packing.class_bounds()
    histogram = dict(zip(*[x.tolist() for x in np.unique(np.searchsorted(bounds, np.minimum(4096, r.lognormal(6, 1.1, 20_000).astype(int) + 1)), return_counts=True)], strict=True))
    used = sum(times for times, _, _ in packing.patterns(histogram, bounds))
    assert used <= 1.01 * sum(bounds[c] * n for c, n in histogram.items()) / packing.CAPACITY


def _check_files(spark, docs, path, **options):
    """Writes the documents, and holds what is read back, all of it and by shuffled rows of the index, against the library."""
    index = tokenfile.write_token_files(docs, path, BYTES, 50255).cache()
    rows = tokenfile.with_start(tokenfile.read_all(spark, f"{path}/shards"), index).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    texts = {}
    for d, t in want:
        texts.setdefault(d, []).append([*_ids(BYTES, t), 50255])
    start = 0
    for r in rows:
        assert r["ids"] in texts[r["doc_id"]] and r["start"] == start
        texts[r["doc_id"]].remove(r["ids"])
        start += len(r["ids"])
    every = {(r["shard"], r["ordinal"]): r["ids"] for r in rows}
    assert len(every) == len(rows) == index.count()
    shuffled = tokenfile.read_frames(f"{path}/shards", index.repartition(3, F.rand(1))).collect()
    assert {(r["shard"], r["ordinal"]): r["ids"] for r in shuffled} == every
    digests = tokenfile.read_all(spark, f"{path}/shards", digest=True).collect()
    assert sorted(r["ids_crc32"] for r in digests) == sorted(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    return index


def test_token_files(spark, odd, empty, tmp_path):
    _check_files(spark, odd, str(tmp_path / "t"))
    assert tokenfile.write_token_files(empty, str(tmp_path / "e"), BYTES, 2).count() == 0
    assert tokenfile.read_all(spark, str(tmp_path / "e/shards")).count() == 0


def test_token_files_of_many_files_for_a_task(spark, tmp_path):
    """The writer's limit of records, and the module's of bytes, make several files of one task; both are read back in order."""
    docs = spark.createDataFrame([(k // 2, f"text {k} " * (k % 7)) for k in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "30")
    sizes = tokenfile.ROLL_BYTES
    try:
        one = _check_files(spark, docs, str(tmp_path / "records"))
        tokenfile.ROLL_BYTES = 2000
        two = _check_files(spark, docs, f"file://{tmp_path}/bytes")
    finally:
        tokenfile.ROLL_BYTES = sizes
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert one.select("file").distinct().count() > 10 < two.select("file").distinct().count()


def test_a_repeated_id_is_dealt_out(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {k % 5}") for k in range(300)], "doc_id long, text string").repartition(6)
    sizes = tokenfile.SHARD_BYTES
    tokenfile.SHARD_BYTES = 500
    try:
        index = _check_files(spark, docs, str(tmp_path / "r"))
    finally:
        tokenfile.SHARD_BYTES = sizes
    assert index.select("shard").distinct().count() > 3


def test_damaged_frames():
    import zstandard

    one = tokenfile.frame(7, np.array([1, 70_000], tokens.ID), zstandard.ZstdCompressor()) + b"\n"
    _, _, body, check = next(tokenfile.bodies(one))
    assert [x.tolist() if hasattr(x, "tolist") else x for x in tokenfile.parse(body, check, zstandard.ZstdDecompressor())] == [7, [1, 70_000]]
    with pytest.raises(tokenfile.DamagedFrame):
        list(tokenfile.bodies(b"\1" + one[1:]))
    with pytest.raises(tokenfile.DamagedFrame):
        list(tokenfile.bodies(one[:-4]))
    with pytest.raises(tokenfile.DamagedFrame):
        tokenfile.parse(bytes([body[0] ^ 1]) + body[1:], check, zstandard.ZstdDecompressor())
