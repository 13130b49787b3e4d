"""Verification of chunks as they arrive.

Clips: a stream of chunks meets the proofs of known manifests, and each row is judged by itself. Originals: a track's hashes gather as
state until all its chunks have come, then its root is compared; a watermark (an addition of ours) bounds how long a track may take.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediastrata.functions.hashing import blake3, hash_column, hex_column, slabs, together
from mediastrata.operators import merkle
from mediastrata.plans import manifests as m
from mediastrata.plans import works


@F.arrow_udf(T.BooleanType())
def _proves(proof: pa.Array, root: pa.Array) -> pa.Array:
    """Whether each proof's path leads from its hash to the root."""
    out = []
    pairs = zip(root.to_pylist(), proof.to_pylist(), strict=True)
    for slab in slabs(pairs, lambda x: 96 * (1 + len(x[1]["path"] or ()))):
        jobs = [m.proving([(r or "", {"hash": p["hash"] or "", "path": p["path"] or []}) for r, p in slab])]
        out += together(jobs)[0]
    return pa.array(out, pa.bool_())


def known_proofs(manifests: DataFrame, compat: bool = False) -> DataFrame:
    """(work_id, track_id, chunk_index, expected, proved): the first proof of every chunk of the clips, judged once against its root.

    compat: a chunk is looked up by its index in any track, and the root is the first track's.
    """
    proofs, tracks = works.clip_proofs(manifests), works.original_tracks(manifests)
    keys = ["work_id"] if compat else ["work_id", "track_id"]
    first = F.min_by("merkle_root", "track_ord") if compat else F.first("merkle_root")
    roots = tracks.groupBy(*keys).agg(first.alias("root"))
    chosen = proofs.groupBy(*keys, "chunk_index").agg(F.min_by(F.struct("hash", "path"), "proof_ord").alias("p"))
    return chosen.join(roots, keys, "left").select(*keys, "chunk_index", F.col("p.hash").alias("expected"), _proves("p", "root").alias("proved"))


def verify_chunks(chunks: DataFrame, manifests: DataFrame, compat: bool = False) -> DataFrame:
    """Adds valid to each chunk (work_id, track_id, chunk_index, data) of a stream or a table; false for works that aren't known or can't be read.

    Proofs are judged once, before any chunk comes; a chunk meets its own proof's row, and only its bytes are hashed then.
    compat: originals' chunks are valid, and a clip's are looked up by index alone under the first track's root.
    """
    proofs = known_proofs(manifests, compat)
    keys = ["work_id", "chunk_index"] if compat else ["work_id", "track_id", "chunk_index"]
    rows = chunks.join(proofs.withColumnsRenamed({"expected": "__expected", "proved": "__proved"}), keys, "left")
    hashed = hex_column(hash_column(F.coalesce("data", F.lit(b"")), "blake3"))
    valid = F.coalesce((hashed == F.col("__expected")) & F.col("__proved"), F.lit(False))
    if compat:
        originals = works.original_tracks(manifests).where("kind = 'Original'").select("work_id", F.lit(True).alias("__original")).distinct()
        rows = rows.join(originals, "work_id", "left")
        valid = F.coalesce("__original", valid)
    return rows.withColumn("valid", valid).select(*chunks.columns, "valid")


def verify_json(rows: DataFrame) -> DataFrame:
    """Adds valid to rows (manifest, chunk_index, data), each with its clip's manifest as JSON: by index alone, as a verifier does that knows no tracks."""
    named = rows.withColumns({"work_id": F.sha2("manifest", 256), "track_id": F.lit(None).cast("bigint")})
    known = named.select("work_id", "manifest").distinct()
    return verify_chunks(named, known, compat=True).drop("work_id", "track_id")


def has_signatures(manifests: DataFrame) -> DataFrame:
    """work_id and signed: whether there is any signature at all. None is checked here."""
    parsed = F.from_json("manifest", "signatures array<struct<public_key: string>>")
    return manifests.select("work_id", F.coalesce(F.size(parsed["signatures"]) > 0, F.lit(False)).alias("signed"))


ROOT_SCHEMA = "work_id string, track_id bigint, n_chunks bigint, merkle_root string, ok boolean"


def track_roots(chunks: DataFrame, tracks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of one row per track (ROOT_SCHEMA) once all its chunks have come, in any order; ok null: they didn't come in time.

    chunks: a stream of work_id, track_id, chunk_index, data, ts. tracks: a table of work_id, track_id, total_chunks, merkle_root. Only hashes are kept,
    and a chunk that comes again counts once.
    """

    def judge(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        work, track = key
        total, root, hashes = state.get if state.exists else (0, "", "{}")
        seen: dict[str, str] = json.loads(hashes)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"work_id": [work], "track_id": [track], "n_chunks": [len(seen)], "merkle_root": [None], "ok": [None]})
            return
        latest = 0
        for pdf in batches:
            total, root = int(pdf["total_chunks"].iloc[0]), pdf["merkle_root"].iloc[0]
            latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
            seen.update((str(i), blake3(d).hex()) for i, d in zip(pdf["chunk_index"], pdf["data"], strict=True))
        if len(seen) < total:
            state.update((total, root, json.dumps(seen)))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
            return
        if state.exists:
            state.remove()
        found = merkle.tree([bytes.fromhex(seen[i]) for i in sorted(seen, key=int)])[-1][0].hex()
        yield pd.DataFrame({"work_id": [work], "track_id": [track], "n_chunks": [len(seen)], "merkle_root": [found], "ok": [found == root]})

    timed = chunks.withWatermark("ts", delay)
    joined = timed.join(tracks.select("work_id", "track_id", "total_chunks", "merkle_root"), ["work_id", "track_id"])
    return joined.groupBy("work_id", "track_id").applyInPandasWithState(judge, ROOT_SCHEMA, "total bigint, root string, hashes string", "append", GroupStateTimeout.EventTimeTimeout)
