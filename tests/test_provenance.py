"""Containers, Merkle trees, ranges, and whole works."""

from __future__ import annotations

import io
import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediastrata.functions.ed25519 import SigningKey
from mediastrata.functions.hashing import blake3
from mediastrata.operators import entries, merkle, policy, ranges
from mediastrata.plans import manifests as m
from mediastrata.plans import works
from mediastrata.sources import container
from mediastrata.streaming import verifier
from tests import media_samples as make

AUTHOR, TTP = SigningKey(bytes(range(32))), SigningKey(bytes(32))
SIGNERS = m.Signers(AUTHOR, TTP, "Ann")
TTP_KEY = TTP.public_key().hex()


def test_container_round_trip():
    data = container.to_bytes(b'{"a":1}', [(0, "raw", 2, 5)], [(0, 0, None, b"hello"), (0, 1, 7, b"world")])
    c = container.open_container(f := io.BytesIO(data))
    assert (c.version, c.manifest, c.tracks) == (2, b'{"a":1}', [(0, "raw", 2, 5, 2)])
    assert c.read(f, 0, 5) == b"hello" and c.read_fixed(f, 1, 5) == b"world"
    assert [s[0] for s in c.sections] == [1, 3, 4, 2]
    rows = list(container.rows("chunks", "p", f))
    assert rows == [("p", 0, 0, 0, None, 0, 5, b"hello"), ("p", 0, 1, 1, 7, 5, 5, b"world")]
    with pytest.raises(container.ContainerError, match="outside of track data"):
        c.read(f, 6, 5)
    with pytest.raises(container.ContainerError, match="Invalid range"):
        c.check_range(2**64 - 1, 5)
    assert next(container.rows("manifests", "p", f))[5] == len(data)


def test_container_versions_and_damage():
    first = container.MAGIC + struct.pack("<IQ", 1, 2) + b"{}" + b"legacy"
    c = container.open_container(f := io.BytesIO(first))
    assert c.read(f, 0, 6) == b"legacy" and c.tracks == []
    with pytest.raises(container.ContainerError, match=r"Invalid magic.*\[87, 82, 78, 71\]"):
        container.open_container(io.BytesIO(b"WRNG1234"))
    with pytest.raises(container.ContainerError, match="Unsupported version"):
        container.open_container(io.BytesIO(container.MAGIC + struct.pack("<I", 9)))
    section = container._section
    head = container.MAGIC + struct.pack("<I", 2)
    index = lambda n: struct.pack("<Q", 1) + struct.pack("<IQqQQ", 0, n, container.NO_PTS, 0, 1)
    odd = head + section(9, b"??") + section(2, b"x") + section(1, b"old") + section(4, index(0)) + section(1, b"new") + section(4, index(1)) + b"abc"
    c = container.open_container(io.BytesIO(odd))
    assert c.manifest == b"new" and len(c.index) == 2 and c.data_length == 1
    with pytest.raises(container.ContainerError, match="Missing manifest"):
        container.open_container(io.BytesIO(head + section(2, b"x")))
    with pytest.raises(container.ContainerError, match="Missing track data"):
        container.open_container(io.BytesIO(head + section(1, b"x")))
    with pytest.raises(container.ContainerError, match="unexpected end"):
        container.open_container(io.BytesIO(head + section(1, b"x" * 9)[:-3]))
    with pytest.raises(container.ContainerError, match="hasn't the chunks"):
        container.to_bytes(b"", [(0, "raw", 2, 5)], [(0, 0, None, b"x")])


def _leaf(k: int) -> bytes:
    return blake3(f"chunk{k}".encode())


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40))
def test_every_blake3_proof_verifies(n):
    leaves = [_leaf(k) for k in range(n)]
    levels = merkle.tree(leaves)
    for pos in range(n):
        path = [{"is_left": bool(pos >> k & 1), "hash": level[(pos >> k) ^ 1].hex()} for k, level in enumerate(levels[:-1]) if (pos >> k) ^ 1 < len(level)]
        proof = {"hash": leaves[pos].hex(), "path": path}
        assert m.proves(levels[-1][0].hex(), proof)
        assert not m.proves(levels[-1][0].hex(), {**proof, "hash": _leaf(99).hex()})
        assert not m.proves(levels[-1][0].hex(), {**proof, "hash": "00"})


def test_empty_tree():
    assert merkle.tree([])[-1][0] == bytes(32)


def _index(spark, rows):
    return spark.createDataFrame(rows, "track long, chunk_index long, pts long")


def _requests(spark, rows):
    return spark.createDataFrame(rows, "request_id int, track long, start_time double, end_time double, first_chunk long, end_chunk long, timebase_num long, timebase_den long")


def test_range_goldens(spark):
    video = [(0, k, 30 * k) for k in range(10)]
    audio = [(1, k, k * 1024 * 1_000_000 // 48000) for k in range(500)]
    chunks = _index(spark, video + audio + [(2, 0, None), (3, 0, 5), (3, 1, 5), (3, 2, 9)])
    asked = [
        (0, 0, 2.0, 6.0, 2, 6, 1, 30), (1, 1, 2.0, 6.0, None, None, 1, 1_000_000), (2, 1, 2.5, 5.5, None, None, 1, 1_000_000), (3, 0, None, None, 0, 10, 1, 30), (4, 0, 6.0, 2.0, 4, 4, 1, 30), (5, 0, 2.0, 6.0, 2, 6, 0, 30),
        (6, 2, 0.0, 1.0, 0, 1, 1, 30), (7, 3, 0.2, 0.25, 0, 2, 1, 30), (8, 0, -1.0, 2.0, 50, 60, 1, 30),
    ]
    got = {r["request_id"]: (r["first_chunk"], r["end_chunk"]) for r in ranges.time_to_chunks(_requests(spark, asked), chunks, ["track"]).collect()}
    assert got == {0: (2, 6), 1: (93, 282), 2: (117, 258), 3: (0, 10), 4: (None, None), 5: (None, None), 6: (None, None), 7: (1, 2), 8: (None, None)}
    back = {r["request_id"]: (r["start_time"], r["end_time"]) for r in ranges.chunks_to_time(_requests(spark, asked), chunks, ["track"]).collect()}
    assert back[0] == (2.0, 6.0) and back[3] == (0.0, 10.0)
    assert back[4] == back[5] == back[6] == back[8] == (None, None)


def test_policies(spark):
    rows = [("none", 0, None, None, None), ("ttp", 1, TTP_KEY, True, "T"), ("both", 1, "k", True, None), ("both", 2, TTP_KEY, True, None), ("bad", 1, "k", False, "x"), ("bad", 2, TTP_KEY, True, None), ("upper", 1, TTP_KEY.upper(), True, None)]
    signatures = spark.createDataFrame(rows[1:], "work string, ord int, public_key string, valid boolean, display_name string")
    got = {r["work"]: r["ok"] for r in policy.signature_policy(signatures, ["work"], TTP_KEY).collect()}
    assert got == {"ttp": True, "both": True, "bad": False, "upper": False}
    authors = spark.createDataFrame([("both", 1, "k", "Kay"), ("bad", 1, "z", "x")], "work string, ord int, author_id string, name string")
    labels = {(r["work"], r["ord"]): r["label"] for r in policy.signature_labels(signatures, authors, ["work"], TTP_KEY).collect()}
    assert labels == {("ttp", 1): "T", ("both", 1): "Kay", ("both", 2): policy.DEFAULT_TTP_NAME, ("bad", 1): "x", ("bad", 2): policy.DEFAULT_TTP_NAME, ("upper", 1): "Author Key"}
    with pytest.raises(Exception, match="outside of track data"):
        spark.createDataFrame([(bytearray(b"abc"),)], "d binary").select(entries.chunk_bytes(F.col("d"), F.lit(2), F.lit(2))).collect()


REQUEST = "request_id int, derivative_id string, work_id string, track_id long, start_time double, end_time double, start_chunk long, end_chunk long"


@pytest.fixture(scope="module")
def signed(spark):
    rows = [("w1", 0, bytearray(make.adts(200))), ("w1", 1, bytearray(b"hello world" * 1000)), ("w2", 0, bytearray(make.h264()))]
    manifests, chunks = works.sign(spark.createDataFrame(rows, "work_id string, input_ord int, data binary"), SIGNERS, title="Ünï", cap=4096)
    return manifests.cache(), chunks.cache()


@pytest.fixture(scope="module")
def clipped(spark, signed):
    asked = [(1, "d1", "w1", 0, 1.0, 3.0, None, None), (2, "d2", "w2", 0, None, None, 2, 3), (3, "d3", "w1", 1, 0.0, 1.0, None, None)]
    manifests, chunks, _ = works.clip(*signed, spark.createDataFrame(asked, REQUEST), SIGNERS)
    return manifests.cache(), chunks.cache()


def test_sign_and_verify(spark, signed):
    manifests, chunks = signed
    assert {r["work_id"]: r["ok"] for r in works.verify(manifests, chunks, TTP_KEY).collect()} == {"w1": True, "w2": True}
    content = json.loads(manifests.where("work_id = 'w1'").first()["manifest"])["content"]
    assert [t["codec"] for t in content["tracks"]] == ["aac", "raw"] and content["title"] == "Ünï"
    offsets = [(c["offset"], c["size"]) for t in content["tracks"] for c in t["chunk_index"]]
    assert all(a + b == c for (a, b), (c, _) in zip(offsets, offsets[1:], strict=False))
    bad = chunks.withColumn("data", F.when(F.col("chunk_index") == 1, F.lit(b"x")).otherwise(F.col("data")))
    got = works.verify(manifests, bad, TTP_KEY).where("work_id = 'w1'").first()
    assert not got["ok"] and got["first_failure"] == "merkle_root" and [f["track_id"] for f in got["failures"]] == [0, 1]
    forged = manifests.withColumn("manifest", F.replace("manifest", F.lit("Default Author"), F.lit("Someone Else")))
    got = works.verify(forged, chunks, TTP_KEY).where("work_id = 'w1'").first()
    assert got["first_failure"] == "signatures" and {f["code"] for f in got["failures"]} == {"signatures", "fingerprint"}
    got = works.verify(manifests, chunks, "00" * 32).where("work_id = 'w1'").first()
    assert got["first_failure"] == "signatures_ttp"
    with pytest.raises(ValueError, match="role"):
        works.sign(manifests, SIGNERS, author_role="king")


def test_clip(spark, signed, clipped):
    manifests, chunks = clipped
    assert {r["work_id"]: r["ok"] for r in works.verify(manifests, chunks, TTP_KEY).collect()} == {"d1": True, "d2": True}
    got = {r["work_id"]: r["k"] for r in chunks.groupBy("work_id").agg(F.sort_array(F.collect_list("chunk_index")).alias("k")).collect()}
    assert got["d1"] == [1, 2, 3] and got["d2"][-1] == 2
    assert chunks.where("work_id = 'd1' AND chunk_index = 1").first()["offset"] == 0
    extra = chunks.withColumn("size", F.col("size") + F.when(F.col("chunk_index") == 2, 1).otherwise(0))
    assert "extra_bytes" in {f["code"] for f in works.verify(manifests, extra, TTP_KEY).where("work_id = 'd1'").first()["failures"]}
    missing = chunks.where("chunk_index <> 2")
    assert "chunk_hash" in {f["code"] for f in works.verify(manifests, missing, TTP_KEY).where("work_id = 'd1'").first()["failures"]}


def test_clip_of_a_clip(spark, clipped):
    asked = spark.createDataFrame([(1, "e1", "d1", 0, 2.0, None, None, None)], REQUEST)
    manifests, chunks, _ = works.clip(*clipped, asked, SIGNERS)
    manifests, chunks = manifests.cache(), chunks.cache()
    assert works.verify(manifests, chunks, TTP_KEY).first()["ok"]
    assert {r["chunk_index"] for r in chunks.collect()} < {1, 2, 3}
    row = works.report(manifests).first()
    assert (row["kind"], row["n_ancestors"], row["title"]) == ("Derivative", 1, "Ünï")


def test_tags(spark, signed, clipped):
    every = signed[0].unionByName(clipped[0])
    tagged = works.tags(every, TTP_KEY).cache()
    assert {r["mismatches"] for r in works.verify_metadata(tagged).collect()} == {""}
    d1 = dict(tagged.where("work_id = 'd1'").first()["tags"])
    assert d1["smed.type"] == "derivative" and d1["smed.original_work_id"] == "w1" and d1["smed.ttp_name"] == policy.DEFAULT_TTP_NAME
    shouted = {k.upper(): v for k, v in d1.items()}
    assert m.metadata_mismatches(shouted) == []
    assert m.metadata_mismatches({}) == ["Missing smed.manifest_b64 tag"]
    assert m.metadata_mismatches({**d1, "smed.manifest_b64": "?"})[0].startswith("Unreadable")
    changed = m.metadata_mismatches({**d1, "smed.original_work_id": "w9", "smed.content_hash": "00"})
    assert [x.split(" ")[0] for x in changed] == ["smed.content_hash", "smed.original_work_id"]
    assert m.metadata_mismatches({k: v for k, v in d1.items() if k == "smed.manifest_b64"})[-1].startswith("Missing work id")


def test_extract(spark, signed):
    got = {(r["work_id"], r["track_id"]): r for r in works.extract(*signed, "mp4").collect()}
    assert bytes(got["w2", 0]["data"]) == make.h264() and got["w1", 1]["error"]
    assert bytes(got["w1", 0]["data"]) == make.adts(200)


def test_container_source(spark, signed, tmp_path):
    container.register(spark)
    works.containers(*signed).write.format("provenance").mode("append").save(str(tmp_path / "out"))
    read = lambda table: spark.read.format("provenance").option("table", table).load(str(tmp_path / "out"))
    assert read("manifests").count() == 2 and read("sections").count() == 8
    want = {(r["work_id"], r["track_id"], r["chunk_index"]): (bytes(r["data"]), r["pts"], r["offset"]) for r in signed[1].collect()}
    got = {(r["path"].rpartition("/")[2][:2], r["track_id"], r["chunk_index"]): (bytes(r["data"]), r["pts"], r["offset"]) for r in read("chunks").collect()}
    assert got == want
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).select("path", F.col("content").alias("data"))
    assert container.parse_files(files, "tracks").count() == read("tracks").count() == 3


def test_streamed_chunks(spark, signed, clipped, tmp_path):
    clipped[1].withColumn("data", F.when(F.col("chunk_index") == 3, F.lit(b"x")).otherwise(F.col("data"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(clipped[1].schema).parquet(str(tmp_path / "in"))
    query = verifier.verify_chunks(stream, clipped[0]).select("work_id", "chunk_index", "valid").writeStream.format("memory").queryName("judged").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["work_id"], r["chunk_index"]): r["valid"] for r in spark.sql("SELECT * FROM judged").collect()}
    assert got["d1", 1] and got["d1", 2] and not got["d1", 3]
    originals = verifier.verify_chunks(signed[1].limit(1), signed[0])
    assert not originals.first()["valid"]
    assert verifier.verify_chunks(signed[1].limit(1), signed[0], compat=True).first()["valid"]


def test_streamed_roots(spark, signed, tmp_path):
    chunks = signed[1].where("work_id = 'w1'").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    chunks.repartition(2).write.parquet(str(tmp_path / "in"))
    tracks = works.original_tracks(signed[0]).select("work_id", "track_id", "total_chunks", "merkle_root")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = verifier.track_roots(stream.select("work_id", "track_id", "chunk_index", "data", "ts"), tracks).writeStream.format("memory").queryName("roots").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["track_id"], r["ok"]) for r in spark.sql("SELECT * FROM roots").collect()} == {(0, True), (1, True)}
