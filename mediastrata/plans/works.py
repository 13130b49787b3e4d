"""Whole works as DataFrames: sign, verify, clip, extract, and the metadata of extracted files.

A work is a row of manifests (work_id, manifest) and rows of chunks (work_id, track_id, chunk_index, pts, is_idr, offset, size, data). Payloads
stay where they were cut: only hashes and numbers are shuffled. A manifest that can't be read fails by itself and no other's checks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediastrata.functions.canonical import canonical, to_bytes
from mediastrata.functions.codec_facts import with_extradata
from mediastrata.functions.detect import VIDEO_CODECS, extension_matches, track_label
from mediastrata.functions.hashing import Hashing, hash_column, hex_column, slabs, together
from mediastrata.functions.perceptual import perceptual_hash_column
from mediastrata.operators import entries, merkle, policy, ranges
from mediastrata.operators.chunking import DEFAULT_CAP
from mediastrata.plans import manifests as m
from mediastrata.sources import container, external
from mediastrata.sources.media import chunk_tracks
from mediastrata.sources.staging import written

_FACTS = ["codec", "container_type", "codec_extradata", "width", "height", "sample_rate", "channel_count", "timebase_num", "timebase_den"]
_STEP = T.StructType([T.StructField("is_left", T.BooleanType()), T.StructField("hash", T.StringType())])


#: Tables of so many rows at most, counted first, are broadcast to rows that hold payloads.
BROADCAST_ROWS = 1_000_000
#: Bytes of a part of an extracted track, about.
PART_BYTES = 64 << 20
#: From so many rows on, manifests that are to be signed are dealt out to all tasks.
DEALT_ROWS = 1_000


def _beside_payload(small: DataFrame) -> DataFrame:
    """A table of numbers for a join with rows that hold payloads: broadcast if it has BROADCAST_ROWS at most, else joined by shuffling both."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """n rows by their key, for signing: in as many tasks as shuffles have, as its time goes by rows, by whose few bytes they'd be one task's."""
    return rows if n < DEALT_ROWS else rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def sign(
    files: DataFrame,
    signers: m.Signers,
    title: str = "Untitled",
    author_name: str = "Default Author",
    author_role: str = "original",
    created_at: str = "1970-01-01T00:00:00Z",
    cap: int = DEFAULT_CAP,
    codec_col: str | None = None,
    container_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(manifests, chunks) of works whose inputs are rows (work_id, input_ord, data); a work's track ids run on over its inputs.

    The role and the keys are checked before any media is read. Times are arguments, so that a run can be repeated. Inputs are cut and
    hashed once, into a written table; offsets inside an input are known there, and only its base is joined to its chunks.
    """
    if author_role.lower() not in m.ROLES:
        raise ValueError(f"author role must be one of {', '.join(m.ROLES)}")
    author = {"author_id": signers.author.public_key().hex(), "name": author_name, "role": author_role.lower()}
    cut = chunk_tracks(files, ["work_id", "input_ord"], codec_col=codec_col, container_col=container_col, cap=cap)
    cut = cut.withColumn("size", F.octet_length("data").cast("bigint")).withColumn("hash", hex_column(hash_column(F.col("data"), "blake3")))
    cut = written(cut.withColumn("perceptual_hash", F.when(F.col("chunk_index") == 0, perceptual_hash_column(F.col("data")))), "signed-chunks")
    along = Window.partitionBy("work_id").orderBy("input_ord")
    base = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    inputs = cut.groupBy("work_id", "input_ord").agg(F.sum("size").alias("n"))
    inputs = written(inputs.select("work_id", "input_ord", (F.row_number().over(along) - 1).cast("bigint").alias("track_id"), base.alias("base")), "signed-inputs")
    placed = cut.join(_beside_payload(inputs), ["work_id", "input_ord"]).withColumn("offset", F.col("base") + F.col("at"))
    meta = placed.drop("data")
    roots = merkle.roots(meta, ["work_id", "track_id"], algorithm="blake3")
    tracks = meta.groupBy("work_id", "track_id", *_FACTS).agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "pts", "offset", "size"))).alias("chunk_index"), F.max("perceptual_hash").alias("perceptual_hash"), F.count("*").alias("total_chunks"), F.lit(cap).cast("bigint").alias("chunk_size")
    )
    tracks = tracks.join(roots.select("work_id", "track_id", "merkle_root"), ["work_id", "track_id"])
    works = _dealt(tracks, inputs.count(), "work_id").groupBy("work_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("track_id", *_FACTS, "merkle_root", "perceptual_hash", "total_chunks", "chunk_size", "chunk_index")))).alias("tracks"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slab in slabs(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lambda x: len(x[1])):
                out += _texts(m.signed([m.original(str(w), title, [author], created_at, json.loads(t)) for w, t in slab], signers))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["work_id", "manifest"])

    kind = dict(files.dtypes)["work_id"]
    return works.mapInArrow(write, f"work_id {kind}, manifest string"), placed.select("work_id", "track_id", "chunk_index", "pts", "is_idr", "offset", "size", "data")


def _texts(manifests: list[dict[str, Any]]) -> list[str]:
    return [to_bytes(x).decode() for x in manifests]


def _checking(text: str | None, ttp_key: str) -> Hashing[list[m.Check]]:
    """The checks of one manifest; one that can't be read, or lacks what it must hold, fails as malformed."""
    try:
        return (yield from m.checks(canonical("manifest", json.loads(text or "")), ttp_key))
    except (ValueError, KeyError, TypeError, AttributeError, IndexError) as e:
        return [m.Check("malformed", -1, False, message=f"{type(e).__name__}: {e}"[:200])]


def resigned(manifests: DataFrame, signers: m.Signers, change: Callable[[dict[str, Any]], dict[str, Any]]) -> DataFrame:
    """The manifests with their contents changed and signed anew, as an editor does who holds the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slab in slabs(batch.column(1).to_pylist(), len):
                out += _texts(m.signed([change(canonical("manifest", json.loads(t))["content"]) for t in slab], signers))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["work_id", "manifest"])

    kind = dict(manifests.dtypes)["work_id"]
    return manifests.select("work_id", "manifest").mapInArrow(run, f"work_id {kind}, manifest string")


def manifest_checks(manifests: DataFrame, ttp_key: str) -> DataFrame:
    """(work_id, code, ord, ok, track_id, chunk_index, message) of the checks that need no media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slab in slabs(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lambda x: len(x[1] or "")):
                found = together([_checking(text, ttp_key) for _, text in slab])
                rows += [(work, c.code, c.order, c.ok, c.track_id, c.chunk_index, c.message) for (work, _), own in zip(slab, found, strict=True) for c in own]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["work_id", "code", "ord", "ok", "track_id", "chunk_index", "message"])

    kind = dict(manifests.dtypes)["work_id"]
    return manifests.select("work_id", "manifest").mapInArrow(run, f"work_id {kind}, code string, ord bigint, ok boolean, track_id bigint, chunk_index bigint, message string")


def original_tracks(manifests: DataFrame) -> DataFrame:
    """(work_id, kind, track_ord, track_id, codec, timebase_num, timebase_den, merkle_root, container_type, codec_extradata) of the original's tracks."""
    track = "array<struct<track_id: bigint, codec: string, timebase_num: bigint, timebase_den: bigint, merkle_root: string, container_type: string, codec_extradata: string, total_chunks: bigint, chunk_size: bigint>>"
    parsed = F.from_json("manifest", f"content struct<type: string, tracks: {track}, original_owd: struct<tracks: {track}>>")
    content = manifests.select("work_id", parsed.alias("p")).select("work_id", "p.content.*")
    return content.select("work_id", F.col("type").alias("kind"), F.posexplode(F.coalesce("tracks", "original_owd.tracks")).alias("track_ord", "t")).select("work_id", "kind", "track_ord", "t.*")


def clip_proofs(manifests: DataFrame) -> DataFrame:
    """(work_id, track_id, proof_ord, chunk_index, hash, chunk_size, pts, path) of clips."""
    proof = "struct<chunk_index: bigint, hash: string, path: array<struct<is_left: boolean, hash: string>>, chunk_size: bigint, pts: bigint>"
    parsed = F.from_json("manifest", f"content struct<clip_mappings: array<struct<track_id: bigint, proofs: array<{proof}>>>>")
    mapped = manifests.select("work_id", F.posexplode(parsed["content"]["clip_mappings"]).alias("k", "x"))
    each = mapped.select("work_id", "k", F.col("x.track_id").alias("track_id"), F.posexplode("x.proofs").alias("j", "p"))
    return each.select("work_id", "track_id", (F.col("k") * F.lit(2**32) + F.col("j")).alias("proof_ord"), "p.chunk_index", "p.hash", "p.chunk_size", "p.pts", "p.path")


def verify(manifests: DataFrame, chunks: DataFrame, ttp_key: str) -> DataFrame:
    """work_id, ok, failures, first_failure: every failed check of each work, and the one that a check in order would stop at.

    Originals: signatures, fingerprint, and each track's root over its chunks. Clips: signatures, fingerprint, the chain, each proof's
    path, each chunk's hash against its proof, and that the payload holds what the proofs account for and no more.
    """
    hashed = written(chunks.select("work_id", "track_id", "chunk_index", "size", hex_column(hash_column(F.col("data"), "blake3")).alias("hash")), "verify-hashes")
    tracks = original_tracks(manifests)
    roots = merkle.roots(hashed, ["work_id", "track_id"], algorithm="blake3")
    rooted = tracks.where("kind = 'Original'").join(roots.withColumnRenamed("merkle_root", "actual"), ["work_id", "track_id"], "left")
    none = F.lit(None).cast("bigint")
    root_checks = rooted.select(
        "work_id", F.lit("merkle_root").alias("code"), (F.lit(100) + F.col("track_id")).alias("ord"), (F.coalesce("actual", F.lit(merkle.EMPTY_ROOT)) == F.col("merkle_root")).alias("ok"), "track_id", none.alias("chunk_index"), F.lit("Merkle root mismatch").alias("message")
    )
    proofs = clip_proofs(manifests)
    had = hashed.select("work_id", "track_id", "chunk_index", F.col("hash").alias("actual"))
    chunk_checks = proofs.join(had, ["work_id", "track_id", "chunk_index"], "left").select(
        "work_id", F.lit("chunk_hash").alias("code"), F.lit(1_000_001).cast("bigint").alias("ord"), F.coalesce(F.col("actual") == F.col("hash"), F.lit(False)).alias("ok"), "track_id", "chunk_index",
        F.when(F.col("actual").isNull(), "missing chunk of a proof").otherwise("Integrity mismatch").alias("message"),
    )
    proved = proofs.groupBy("work_id").agg(F.sum("chunk_size").alias("proved"))
    held = hashed.groupBy("work_id").agg(F.sum("size").alias("held"))
    extra = tracks.where("kind = 'Derivative'").select("work_id").distinct().join(proved, "work_id", "left").join(held, "work_id", "left")
    extra_checks = extra.select("work_id", F.lit("extra_bytes").alias("code"), F.lit(2_000_000).cast("bigint").alias("ord"), (F.coalesce("proved", F.lit(0)) == F.coalesce("held", F.lit(0))).alias("ok"), none.alias("track_id"), none.alias("chunk_index"), F.lit("extra data beside what the proofs account for").alias("message"))
    every = manifest_checks(manifests, ttp_key).unionByName(root_checks).unionByName(chunk_checks).unionByName(extra_checks)
    failure = F.struct("ord", "code", "track_id", "chunk_index", "message")
    verdict = every.groupBy("work_id").agg(F.bool_and("ok").alias("ok"), F.sort_array(F.collect_list(F.when(~F.col("ok"), failure))).alias("failures"))
    return verdict.withColumn("first_failure", F.get("failures", F.lit(0))["code"])


_MADE = T.ArrayType(T.StructType([T.StructField("chunk_index", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("path", T.ArrayType(_STEP))]))


@F.arrow_udf(_MADE)
def _paths(indexes: pa.Array, hashes: pa.Array, wanted: pa.Array) -> pa.Array:
    """The BLAKE3 proof paths of the wanted leaves of each track."""
    out = []
    for slab in slabs(zip(indexes.to_pylist(), hashes.to_pylist(), wanted.to_pylist(), strict=True), lambda x: 96 * len(x[1])):
        grown = together([merkle.growing([bytes.fromhex(x) for x in leaves]) for _, leaves, _ in slab])
        for (numbers, leaves, chosen), levels in zip(slab, grown, strict=True):
            chosen, made = set(chosen), []
            for pos, number in enumerate(numbers):
                if number in chosen:
                    siblings = [((pos >> k) ^ 1, bool(pos >> k & 1), level) for k, level in enumerate(levels[:-1])]
                    steps = [{"is_left": left, "hash": level[at].hex()} for at, left, level in siblings if at < len(level)]
                    made.append({"chunk_index": number, "hash": leaves[pos], "path": steps})
            out.append(made)
    return pa.array(out, pa.list_(pa.struct([("chunk_index", pa.int64()), ("hash", pa.string()), ("path", pa.list_(pa.struct([("is_left", pa.bool_()), ("hash", pa.string())])))])))


def _mapped(manifests: DataFrame) -> DataFrame:
    """(work_id, track_id) of the tracks that clips map."""
    parsed = F.from_json("manifest", "content struct<clip_mappings: array<struct<track_id: bigint>>>")
    return manifests.select("work_id", F.explode(parsed["content"]["clip_mappings"]["track_id"]).alias("track_id")).distinct()


def _asked(manifests: DataFrame, requests: DataFrame, bases: DataFrame, ttp_key: str) -> DataFrame:
    """requests with codec, timebase, the kind of their range, and error where they can't be answered whatever the chunks are."""
    checked = manifest_checks(manifests, ttp_key).where(F.col("code").isin("malformed", "signatures", "signatures_ttp"))
    sound = checked.groupBy("work_id").agg(F.bool_and("ok").alias("sound"))
    kind = ranges.range_kind(F.col("start_time"), F.col("end_time"), F.col("start_chunk"), F.col("end_chunk"))
    rows = requests.join(sound, "work_id", "left").join(bases, ["work_id", "track_id"], "left").withColumn("kind", kind)
    error = (
        F.when(F.col("sound").isNull(), "no such work")
        .when(~F.col("sound"), "the work's signatures don't hold")
        .when(F.col("codec").isNull(), "the work has no such track")
        .when(F.lower("codec") == "raw", "a raw track can't be clipped")
        .when(F.col("kind").isNull(), "neither times nor chunk indexes are given")
    )
    return written(rows.withColumn("error", error), "clip-requests")


def _windows(asked: DataFrame, index: DataFrame, bases: DataFrame) -> DataFrame:
    """(request_id, start_time, end_time) for every track of each request's work, begun at an IDR of every video track that has one before it."""
    keys = ["work_id", "track_id"]
    opened = asked.where("kind = 'open_time'")
    by_index = asked.where("kind = 'index'").select("request_id", F.col("start_chunk").alias("first_chunk"), "end_chunk")
    if not opened.isEmpty():
        by_index = by_index.unionByName(written(ranges.time_to_chunks(opened, index, keys), "clip-open").select("request_id", "first_chunk", "end_chunk"))
    timed = ranges.chunks_to_time(by_index.join(asked.select("request_id", *keys, "timebase_num", "timebase_den"), "request_id"), index, keys)
    given = asked.where("kind = 'time'").select("request_id", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"))
    window = given.unionByName(timed.select("request_id", "start_time", "end_time")).where("start_time IS NOT NULL AND end_time IS NOT NULL")
    each = window.join(asked.select("request_id", "work_id"), "request_id").join(bases, "work_id").withColumn("part", F.concat_ws("/", "request_id", "track_id"))
    each = written(each, "clip-windows")
    video = each.where(F.lower("codec").isin(*VIDEO_CODECS))
    if video.isEmpty():  # nothing to snap to; the plans of that are most of the driver's work
        return each
    first = written(ranges.time_to_chunks(video, index, keys, "part").where("first_chunk IS NOT NULL").join(video, "part"), "clip-video")
    snapped = written(ranges.snap_to_idr(first, index, keys, "part").where("idr_chunk IS NOT NULL"), "clip-snapped")
    from_idr = snapped.select("part", *keys, F.col("idr_chunk").alias("first_chunk"), (F.col("idr_chunk") + 1).alias("end_chunk"))
    idr_time = ranges.chunks_to_time(from_idr.join(video.select("part", "timebase_num", "timebase_den"), "part"), index, keys, "part")
    earliest = idr_time.join(video.select("part", "request_id"), "part").groupBy("request_id").agg(F.min("start_time").alias("idr_time"))
    return written(each.join(earliest, "request_id", "left").withColumn("start_time", F.least("start_time", "idr_time")), "clip-starts")


def clip(
    manifests: DataFrame, chunks: DataFrame, requests: DataFrame, signers: m.Signers, created_at: str = "1970-01-01T00:00:00Z"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, chunks, errors) of the clips that requests ask for; a clip's work_id is its derivative_id.

    requests: request_id, derivative_id, work_id, track_id (the reference track), start_time, end_time, start_chunk, end_chunk. The range is that of both
    times, else of both chunk indexes on the reference track, else of the one time given. It begins at an IDR of every video track
    that has one before it. Every track with a timebase is cut to it. errors: request_id, derivative_id, work_id and error of each
    request that gives no clip: an unknown or unsound work, a track that is unknown or raw, no usable range, no chunks in it, or a
    chunk of a clip whose proof its manifest lacks.
    """
    keys = ["work_id", "track_id"]
    tracks = written(original_tracks(manifests), "clip-tracks")
    bases = tracks.select(*keys, "codec", "timebase_num", "timebase_den")
    index = written(chunks.select(*keys, "chunk_index", "pts", "is_idr", "size"), "clip-index")
    status = _asked(manifests, requests, bases, signers.ttp.public_key().hex())
    asked = status.where("error IS NULL")
    each = _windows(asked, index, bases)
    cut = ranges.time_to_chunks(each, index, keys, "part").where("first_chunk IS NOT NULL").join(each.select("part", "request_id", *keys), "part")
    selected = written(ranges.select_clip(cut.select("request_id", *keys, "first_chunk", "end_chunk"), index, keys), "clip-selected")

    # Originals: only works and tracks that are cut are hashed, and only selected leaves get a path.
    whole = selected.join(tracks.where("kind = 'Original'").select(*keys).distinct(), keys, "left_semi")
    wanted = whole.groupBy(*keys).agg(F.collect_set("chunk_index").alias("wanted"))
    leaves = chunks.join(_beside_payload(wanted.select(*keys)), keys, "left_semi").select(*keys, "chunk_index", hex_column(hash_column(F.col("data"), "blake3")).alias("hash"))
    own = leaves.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "hash"))).alias("l")).join(wanted, keys)
    made = own.select(*keys, F.explode(_paths(F.col("l.chunk_index"), F.col("l.hash"), F.col("wanted"))).alias("z")).select(*keys, "z.*")
    columns = ["request_id", *keys, "first_chunk", "end_chunk", "chunk_index", "hash", "path", "chunk_size", "pts"]
    fresh = whole.withColumnRenamed("size", "chunk_size").join(made, [*keys, "chunk_index"]).select(columns)

    # Clips: the proofs that they hold; tracks that they don't map are left out, and a chunk without its proof fails the request.
    had = clip_proofs(manifests).groupBy(*keys, "chunk_index").agg(F.max_by(F.struct("hash", "path", "chunk_size", "pts"), "proof_ord").alias("p"))
    parts = selected.select("request_id", *keys, "first_chunk", "end_chunk", "chunk_index").join(_mapped(manifests), keys, "left_semi")
    kept = written(parts.join(had, [*keys, "chunk_index"], "left").select("request_id", *keys, "first_chunk", "end_chunk", "chunk_index", "p.*"), "clip-kept")
    lacking = kept.where("hash IS NULL").groupBy("request_id").agg(F.min(F.struct("track_id", "chunk_index")).alias("x"))
    lacking = lacking.select("request_id", F.format_string("missing proof for chunk %d in track %d", "x.chunk_index", "x.track_id").alias("why"))
    proofs = written(fresh.unionByName(kept.select(columns)).join(lacking, "request_id", "left_anti"), "clip-proofs")

    mapping = proofs.groupBy("request_id", *keys, "first_chunk", "end_chunk").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "hash", "path", "chunk_size", "pts"))).alias("proofs"))
    entry = F.struct("track_id", F.col("first_chunk").alias("start_chunk_index"), F.col("end_chunk").alias("end_chunk_index"), "proofs")
    mappings = mapping.groupBy("request_id", "work_id").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("mappings"))
    named = requests.select("request_id", "derivative_id")
    ready = mappings.join(manifests.select("work_id", "manifest"), "work_id").join(named, "request_id").select("derivative_id", "manifest", "mappings")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clipper = signers.author.public_key().hex()
        for batch in batches:
            out = []
            for slab in slabs(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda x: len(x[1]) + len(x[2])):
                contents = [m.derivative(str(name), canonical("manifest", json.loads(source)), clipper, created_at, json.loads(part)) for name, source, part in slab]
                out += _texts(m.signed(contents, signers))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["work_id", "manifest"])

    id_kind = dict(requests.dtypes)["derivative_id"]
    ordered = entries.with_offsets(proofs.select("request_id", *keys, "chunk_index").join(index, [*keys, "chunk_index"]), ["request_id"], ["track_id", "chunk_index"])
    places = written(ordered.join(named, "request_id").select("derivative_id", *keys, "chunk_index", "offset"), "clip-places")
    rows = chunks.drop("offset").join(_beside_payload(places), [*keys, "chunk_index"])
    rows = rows.select(F.col("derivative_id").alias("work_id"), "track_id", "chunk_index", "pts", "is_idr", "offset", "size", "data")
    why = F.coalesce("error", "why", F.when(F.col("timed").isNull(), "no usable range").when(F.col("cut").isNull(), "no chunks are in the range"))
    told = status.join(lacking, "request_id", "left").join(each.select("request_id", F.lit(True).alias("timed")).distinct(), "request_id", "left")
    told = told.join(proofs.select("request_id", F.lit(True).alias("cut")).distinct(), "request_id", "left").select("request_id", "derivative_id", "work_id", why.alias("error"))
    return _dealt(ready, asked.count(), "derivative_id").mapInArrow(write, f"work_id {id_kind}, manifest string"), rows, told.where("error IS NOT NULL")


def containers(manifests: DataFrame, chunks: DataFrame, name: str = "concat(work_id, '.smed')") -> DataFrame:
    """Rows (name, ord, manifest, tracks, index, data) as the container sink takes them: of each work a head, then its chunks in payload order.

    A work's rows are one task's, in order, so that a file is written as it comes and no work is held in memory.
    """
    sizes = chunks.groupBy("work_id", "track_id").agg(F.count("*").alias("total_chunks"), F.max("size").alias("chunk_size"))
    tracks = sizes.join(original_tracks(manifests).select("work_id", "track_id", "codec"), ["work_id", "track_id"])
    tables = tracks.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("track_id", "codec", "total_chunks", "chunk_size"))).alias("tracks"))
    places = chunks.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("offset", "track_id", "chunk_index", "pts", "size"))).alias("index"))
    heads = manifests.join(tables, "work_id").join(places, "work_id").select(F.expr(name).alias("name"), F.lit(-1).cast("bigint").alias("ord"), "manifest", "tracks", "index")
    known = _beside_payload(written(manifests.select("work_id"), "container-works"))
    rows = chunks.join(known, "work_id", "left_semi").select(F.expr(name).alias("name"), F.col("offset").alias("ord"), "data")
    return heads.unionByName(rows, allowMissingColumns=True).repartition("name").sortWithinPartitions("name", "ord")


def extract(manifests: DataFrame, chunks: DataFrame, extension: str) -> DataFrame:
    """work_id, track_id, codec, mode, part, data, error: each track's bytes in payload order, in parts of about PART_BYTES.

    A single raw track passes through if the extension fits its type. Others are elementary streams to be muxed, video with its parameter sets
    in front; a raw track among several, or an extension that no muxer makes, is an error.
    """
    numbers = chunks.groupBy("work_id", "track_id").agg(F.min("offset").alias("first"))
    own = original_tracks(manifests).join(numbers, ["work_id", "track_id"]).withColumn("n", F.count("*").over(Window.partitionBy("work_id")))
    raw, muxed = F.lower("codec") == "raw", F.lit(extension.lower() in ("mp4", "mkv", "webm"))
    fits = F.coalesce(extension_matches(F.lit(extension), F.col("container_type")), F.lit(False))
    error = (
        F.when(raw & (F.col("n") > 1), "a raw track can't be muxed with others")
        .when(raw & ~fits, "the extension doesn't fit the raw track's type")
        .when(~raw & ~muxed, "the extension needs a raw track")
    )
    kept = own.withColumn("error", error).withColumn("mode", F.when(raw, "passthrough").otherwise("elementary"))
    kept = written(kept.select("work_id", "track_id", "codec", "codec_extradata", "first", "mode", "error"), "extract-tracks")
    part = lambda at: F.floor(at / PART_BYTES).cast("bigint")
    good = chunks.join(_beside_payload(kept.where("error IS NULL")), ["work_id", "track_id"])
    good = good.withColumn("part", part(F.col("offset")) - part(F.col("first")))
    head = F.when(F.col("offset") == F.col("first"), with_extradata(F.col("data"), F.col("codec_extradata"), F.lower("codec"))).otherwise(F.col("data"))
    joined = good.withColumn("data", head).groupBy("work_id", "track_id", "codec", "mode", "part").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY offset)").alias("data"))
    failed = kept.where("error IS NOT NULL").select("work_id", "track_id", "codec", "mode", F.lit(0).cast("bigint").alias("part"), F.lit(None).cast("binary").alias("data"), "error")
    return joined.withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def verify_containers(files: DataFrame, ttp_key: str, path_col: str = "path", data_col: str = "data") -> DataFrame:
    """The verdicts of verify() on whole container files, by path; a file that is no container fails as malformed."""
    parsed = {t: container.parse_files(files, t, path_col, data_col, mode="permissive") for t in ("manifests", "chunks", "errors")}
    manifests = parsed["manifests"].select(F.col("path").alias("work_id"), "manifest")
    good = verify(manifests, parsed["chunks"].withColumnRenamed("path", "work_id"), ttp_key)
    failure = F.struct(F.lit(-2).cast("bigint").alias("ord"), F.lit("malformed").alias("code"), F.lit(None).cast("bigint").alias("track_id"), F.lit(None).cast("bigint").alias("chunk_index"), F.col("error").alias("message"))
    bad = parsed["errors"].select(F.col("path").alias("work_id"), F.lit(False).alias("ok"), F.array(failure).alias("failures"), F.lit("malformed").alias("first_failure"))
    return good.unionByName(bad)


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def _tag_map(manifest: pa.Array, ttp_key: pa.Array) -> pa.Array:
    def one(text: str | None, key: str) -> list[tuple[str, str]] | None:
        try:
            return list(m.tags(json.loads(text or ""), key).items())
        except (ValueError, KeyError, TypeError, AttributeError, IndexError):
            return None

    return pa.array([one(t, k) for t, k in zip(manifest.to_pylist(), ttp_key.to_pylist(), strict=True)], pa.map_(pa.string(), pa.string()))


def tags(manifests: DataFrame, ttp_key: str) -> DataFrame:
    """work_id and the tags that its extracted file carries; null for a manifest that can't be read."""
    return manifests.select("work_id", _tag_map(F.col("manifest"), F.lit(ttp_key)).alias("tags"))


@F.arrow_udf(T.StringType())
def _tag_mismatches(found: pa.Array) -> pa.Array:
    return pa.array([None if t is None else "; ".join(m.metadata_mismatches(dict(t))) for t in found.to_pylist()], pa.string())


def verify_metadata(tagged: DataFrame, tags_col: str = "tags") -> DataFrame:
    """Adds mismatches, '' where the tags agree with the manifest they hold. Signatures aren't checked."""
    return tagged.withColumn("mismatches", F.when(F.col(tags_col).isNull(), "No metadata tags found").otherwise(_tag_mismatches(F.col(tags_col))))


def report(manifests: DataFrame) -> DataFrame:
    """work_id, kind, title, n_authors, n_tracks, n_signatures, n_ancestors, n_mappings of each manifest."""
    owd = "title: string, authors: array<struct<name: string>>, tracks: array<struct<track_id: bigint>>"
    parsed = F.from_json("manifest", f"content struct<type: string, {owd}, original_owd: struct<{owd}>, ancestry: array<struct<content: string>>, clip_mappings: array<struct<track_id: bigint>>>, signatures array<struct<public_key: string>>")
    p = manifests.select("work_id", parsed.alias("p")).select("work_id", "p.content.*", "p.signatures")
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("bigint")
    return p.select(
        "work_id", F.col("type").alias("kind"), F.coalesce("title", "original_owd.title").alias("title"), size(F.coalesce("authors", "original_owd.authors")).alias("n_authors"), size(F.coalesce("tracks", "original_owd.tracks")).alias("n_tracks"),
        size("signatures").alias("n_signatures"), size(F.coalesce("ancestry", F.array().cast("array<struct<content: string>>"))).alias("n_ancestors"), size(F.coalesce("clip_mappings", F.array().cast("array<struct<track_id: bigint>>"))).alias("n_mappings"),
    )


def report_details(manifests: DataFrame, ttp_key: str) -> DataFrame:
    """work_id, section, ord, label, name, first, stop: authors (label: role), tracks (label: kind, name: codec, stop: chunks), mappings (label: the
    track's kind, first and stop: chunks) and signatures (label: whose, name: key) of each manifest."""
    author = "authors: array<struct<author_id: string, name: string, role: string>>"
    track = "tracks: array<struct<track_id: bigint, codec: string, container_type: string, width: bigint, height: bigint, sample_rate: bigint, channel_count: bigint, total_chunks: bigint>>"
    mapping = "clip_mappings: array<struct<track_id: bigint, start_chunk_index: bigint, end_chunk_index: bigint>>"
    schema = f"content struct<type: string, {author}, {track}, clipper_id: string, original_owd: struct<{author}, {track}>, {mapping}>, signatures array<struct<public_key: string, display_name: string>>"
    p = manifests.select("work_id", F.from_json("manifest", schema).alias("p")).select("work_id", "p.content.*", "p.signatures")
    p = p.withColumns({"authors": F.coalesce("authors", "original_owd.authors"), "tracks": F.coalesce("tracks", "original_owd.tracks")})
    none, words = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    row = lambda section, at, label, name, first, stop: ["work_id", F.lit(section).alias("section"), at.cast("bigint").alias("ord"), label.alias("label"), name.alias("name"), first.alias("first"), stop.alias("stop")]
    authors = p.select("work_id", F.posexplode("authors").alias("k", "x")).select(row("author", F.col("k"), F.col("x.role"), F.col("x.name"), none, none))
    each = p.select("work_id", F.explode("tracks").alias("t")).select("work_id", "t.*")
    label = track_label(F.col("container_type"), F.col("codec"), F.col("width"), F.col("height"), F.col("sample_rate"), F.col("channel_count"))
    tracks = each.select(row("track", F.col("track_id"), label, F.col("codec"), none, F.col("total_chunks")))
    known = each.select("work_id", "track_id", label.alias("kind"))
    mapped = p.select("work_id", F.posexplode("clip_mappings").alias("k", "x")).select("work_id", "k", "x.*").join(known, ["work_id", "track_id"], "left")
    mappings = mapped.select(row("mapping", F.col("k"), F.coalesce("kind", F.lit("Unknown")), words, F.col("start_chunk_index"), F.col("end_chunk_index")))
    signed = p.select("work_id", "authors", "clipper_id", F.col("type").alias("of"), F.posexplode("signatures").alias("k", "x"))
    said = policy.clean_name(F.col("x.display_name"))
    own = F.get(F.filter("authors", lambda a: a["author_id"] == F.col("x.public_key")), F.lit(0))["name"]
    whose = F.when(F.col("of") == "Original", own).when(F.col("clipper_id") == F.col("x.public_key"), F.coalesce(said, F.lit("Clipper")))
    ttp = F.when(F.coalesce(F.col("x.display_name"), F.lit(policy.DEFAULT_TTP_NAME)) == policy.DEFAULT_TTP_NAME, "TTP Key").otherwise(F.concat(F.lit("TTP Key ("), "x.display_name", F.lit(")")))
    named = F.when(whose.isNotNull(), F.nullif(whose, F.lit(""))).otherwise(F.col("x.display_name"))
    key = F.when(F.col("x.public_key") == ttp_key, ttp).otherwise(F.coalesce(F.concat(F.lit("Author Key ("), named, F.lit(")")), F.lit("Author Key")))
    signatures = signed.select(row("signature", F.col("k"), key, F.col("x.public_key"), none, none))
    return authors.unionByName(tracks).unionByName(mappings).unionByName(signatures)


def mux(manifests: DataFrame, chunks: DataFrame, extension: str, ttp_key: str) -> DataFrame:
    """work_id, data, error: each work's tracks as one container file with its tags, by an external tool (see sources.external).

    What extract() refuses is refused here. A work's tracks are one task's, as the tool takes them together.
    """
    found = extract(manifests, chunks, extension)
    errors = found.where("error IS NOT NULL").groupBy("work_id").agg(F.min("error").alias("error"))
    bases = original_tracks(manifests).select("work_id", "track_id", "timebase_num", "timebase_den")
    parts = found.join(errors, "work_id", "left_anti").groupBy("work_id", "track_id", "codec").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY part)").alias("data"))
    rows = parts.join(bases, ["work_id", "track_id"]).groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("track_id", "codec", "timebase_num", "timebase_den", "data"))).alias("tracks"))
    kind = dict(manifests.dtypes)["work_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = external.muxed(batch.column(1)[k].as_py(), dict(batch.column(2)[k].as_py() or []), extension)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([out], pa.binary())], names=["work_id", "data"])

    tagged = rows.join(tags(manifests, ttp_key), "work_id").select("work_id", "tracks", "tags")
    made = tagged.mapInArrow(run, f"work_id {kind}, data binary").withColumn("error", F.lit(None).cast("string"))
    return made.unionByName(errors.select("work_id", F.lit(None).cast("binary").alias("data"), "error"))
