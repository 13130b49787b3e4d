"""Work on many small works goes by batches: hashes are made together, keys that come again have tables, and signing is dealt out."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from mediastrata.functions import canonical, ed25519, hashing
from mediastrata.operators import merkle
from mediastrata.plans import manifests as m
from mediastrata.plans import works
from mediastrata.streaming import verifier

SIGNERS = m.Signers(ed25519.SigningKey(bytes(range(32))), ed25519.SigningKey(bytes(32)), "Author")
TTP = SIGNERS.ttp.public_key().hex()
TIME = "1970-01-01T00:00:00Z"


@pytest.fixture
def compressions(monkeypatch):
    """How often either form of the compression is called."""
    calls = [0]
    for name in ("_compress", "_compress_one"):
        real = getattr(hashing, name)

        def counted(*args, real=real):
            calls[0] += 1
            return real(*args)

        monkeypatch.setattr(hashing, name, counted)
    return calls


def _proofs(leaves: list[bytes]) -> tuple[str, list[dict]]:
    levels = merkle.tree(leaves)
    path = lambda pos: [{"is_left": bool(pos >> k & 1), "hash": level[(pos >> k) ^ 1].hex()} for k, level in enumerate(levels[:-1]) if (pos >> k) ^ 1 < len(level)]
    return levels[-1][0].hex(), [{"chunk_index": k, "hash": leaf.hex(), "path": path(k), "chunk_size": 5, "pts": k} for k, leaf in enumerate(leaves)]


def _works(n: int) -> tuple[list[dict], list[dict]]:
    """n originals of five chunks and their clips of two, as contents and as signed manifests."""
    author, contents, mappings = {"author_id": SIGNERS.author.public_key().hex(), "name": "A", "role": "original"}, [], []
    for k in range(n):
        root, proofs = _proofs([hashing._short(b"%d-%d" % (k, i)) for i in range(5)])
        track = {"track_id": 0, "codec": "aac", "merkle_root": root, "total_chunks": 5, "chunk_size": 9, "chunk_index": [{"chunk_index": i, "pts": i, "offset": 5 * i, "size": 5} for i in range(5)]}
        contents.append(m.original(f"w{k}", "T" * 300, [author], TIME, [track]))
        mappings.append([{"track_id": 0, "start_chunk_index": 1, "end_chunk_index": 3, "proofs": proofs[1:3]}])
    originals = m.signed(contents, SIGNERS)
    clips = m.signed([m.derivative(f"c{k}", o, author["author_id"], TIME, x) for k, (o, x) in enumerate(zip(originals, mappings, strict=True))], SIGNERS)
    return originals, clips


def test_many_manifests_are_hashed_together(compressions):
    """clipped_works: a manifest at a time took 17 compressions or more for each hash of over 1 KiB."""
    originals, clips = _works(60)
    compressions[0] = 0
    m.signed([x["content"] for x in originals], SIGNERS)
    assert compressions[0] < 40
    found = hashing.together([m.checks(x, TTP) for x in [*originals, *clips]])
    assert all(c.ok for own in found for c in own) and [len(own) for own in found] == [3] * 60 + [7] * 60
    assert compressions[0] < 100


def test_checks_together_are_those_of_each(compressions):
    originals, clips = _works(6)
    clips[1]["content"]["clip_mappings"][0]["proofs"][1]["path"][0]["hash"] = "00" * 32
    clips[2]["signatures"][1]["signature"] = "00" * 64
    clips[3]["content"]["original_owd"]["tracks"] = []
    texts = [json.dumps(x) for x in [*originals, *clips]] + ["{", None, json.dumps({"content": {"type": "Original"}, "signatures": []})]
    texts.append(json.dumps({**clips[4], "content": {**clips[4]["content"], "original_owd": {**clips[4]["content"]["original_owd"], "title": "\ud800"}}}))
    both = hashing.together([works._checking(t, TTP) for t in texts])
    assert both == [hashing.together([works._checking(t, TTP)])[0] for t in texts]
    bad = [{c.code for c in own if not c.ok} for own in both]
    assert bad[:7] == [set()] * 7 and bad[7] == {"signatures", "proof"} and bad[8] == {"signatures"}
    assert bad[9] == {"signatures", "original_signature", "mapping_track", "proof"} and bad[10:12] == [set()] * 2 and bad[12:] == [{"malformed"}] * 4


def test_many_proofs_are_judged_together(compressions):
    """json_verifier: a level of all paths is hashed at once."""
    root, proofs = _proofs([hashing._short(b"%d" % k) for k in range(300)])
    compressions[0] = 0
    odd = [(root, {**proofs[0], "hash": "00"}), (root, {**proofs[0], "path": [{"is_left": True, "hash": "ab"}]}), ("", proofs[0]), (root, {"hash": "", "path": []}), ("zz", proofs[0])]
    assert hashing.together([m.proving([(root, p) for p in proofs] + odd)]) == [[True] * 300 + [False] * 5]
    assert compressions[0] < 20


def test_json_verifier_of_many_clips(spark):
    _, clips = _works(40)
    texts = [canonical.to_bytes(x).decode() for x in clips]
    rows = [(t, i, b"%d-%d" % (k, i) if i < 3 else b"other") for k, t in enumerate(texts) for i in range(5)] + [("{", 1, b"x")]
    got = verifier.verify_json(spark.createDataFrame(rows, "manifest string, chunk_index bigint, data binary")).collect()
    want = {(t, i): i in (1, 2) for t in texts for i in range(5)} | {("{", 1): False}
    assert len(got) == len(want) and {(r["manifest"], r["chunk_index"]): r["valid"] for r in got} == want


def test_keys_that_come_again_have_tables(monkeypatch):
    """missing_proofs: signing and checking go by tables, and find what the plain form finds."""
    doubled = [0]
    real = ed25519._add
    monkeypatch.setattr(ed25519, "_add", lambda p, q: (doubled.__setitem__(0, doubled[0] + 1), real(p, q))[1])
    key = ed25519.SigningKey(os.urandom(32))
    signatures = [key.sign(b"%d" % k) for k in range(60)]
    ends = [ed25519.verify(key.public_key(), b"%d" % k, s) for k, s in enumerate(signatures)]
    assert ends == [True] * 60
    doubled[0] = 0
    key.sign(b"again")
    for k, s in enumerate(signatures):
        assert not ed25519.verify(key.public_key(), b"other %d" % k, s) and not ed25519.verify(key.public_key(), b"%d" % k, s[:32] + bytes(32))
        high = int.from_bytes(s[32:], "little") + ed25519._L
        assert not ed25519.verify(key.public_key(), b"%d" % k, s[:32] + high.to_bytes(32, "little"))
    assert doubled[0] <= 2 * 60
    for odd in (b"", b"x" * 31, (2**255 - 19).to_bytes(32, "little"), b"\xff" * 32, b"\1" + bytes(30) + b"\x80"):
        assert not ed25519.verify(odd, b"0", signatures[0])


def _audio(k: int, frames: int) -> bytes:
    body = b"%06d" % k
    n = len(body) + 7
    return (bytes.fromhex(f"FFF150{0x80 | n >> 11:02X}{n >> 3 & 255:02X}{(n & 7) << 5 | 31:02X}FC") + body) * frames


def test_signing_many_works_is_dealt_out(spark, monkeypatch):
    """later_clips: manifests are few bytes, and were one task's to sign."""
    tasks = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    rows = [(f"w{k}", 0, bytearray(_audio(k, 90))) for k in range(80)]
    files = spark.createDataFrame(rows, "work_id string, input_ord bigint, data binary")
    monkeypatch.setattr(works, "DEALT_ROWS", 50)
    signed, chunks = works.sign(files, SIGNERS)
    assert tasks(signed) == 4
    held = works.written(signed, "manifests")
    none = F.lit(None).cast("double")
    requests = held.select(F.col("work_id").alias("request_id"), F.concat(F.lit("c"), "work_id").alias("derivative_id"), "work_id", F.lit(0).cast("bigint").alias("track_id"), none.alias("start_time"), none.alias("end_time"), F.lit(1).cast("bigint").alias("start_chunk"), F.lit(3).cast("bigint").alias("end_chunk"))
    clips, parts, errors = works.clip(held, chunks, works.written(requests, "requests"), SIGNERS)
    assert tasks(clips) == 4 and errors.count() == 0 and parts.count() == 160
    verdict = works.verify(clips, parts, TTP).collect()
    assert len(verdict) == 80 and all(r["ok"] for r in verdict)
    monkeypatch.setattr(works, "DEALT_ROWS", 81)
    assert tasks(works.sign(files, SIGNERS)[0]) == 1
