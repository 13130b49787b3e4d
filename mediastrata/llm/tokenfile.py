"""Token-ID output: length-delimited binary records and a separate offset index.

A shard is a run of frames, one for each document:

    length      8 bytes  of the body
    check       4 bytes  masked checksum of the length's bytes
    body        id (8 bytes, signed), flags (1 byte), number of ids (4 bytes), the ids, zstandard-compressed
    check       4 bytes  masked checksum of the body
    end mark    1 byte   a line feed

All integers are little-endian. A checksum is the crc32, rotated right by 15 bits, plus a constant, so that bytes that
hold checksums can be checksummed themselves. Ids take 16 bits where the vocabulary allows (flag 1), else 32; flag 2
marks a null document id.

Shards are written by Spark's own writers and so go to any file system that the cluster has, with its commit protocol:
a lost executor's shards are written again. Documents are range-partitioned by id, and of one id by their text's hash and
where they stood, so that neither long ranges nor a repeated id make a shard long; a shard has about SHARD_BYTES of text,
and a task that gets more begins a new file after each ROLL_BYTES. A shard's number is made of its file's name (task, roll,
and the writer's own file count), so numbers ascend with ids, however many files a task writes.

The index (shard, file, ordinal, offset, size, doc_id, n_tokens, before) is its own Parquet table. A shuffled reader takes
any of its rows, in any order and on any task, and reads just those bytes, on file systems that Arrow opens (file, hdfs,
s3, gs); read_all() takes whole shards by Spark's reader, on any.

Defined cases: a null text counts as empty; an empty document holds the end id only; null ids come first; documents
with the same id follow one another, ordered by their text's hash; an empty table gives no shard and no row; a text of
any length is one frame; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediastrata.llm.common import fresh_path, slices, table, text_list
from mediastrata.llm.tokens import ID, encoder

_LENGTH, _CHECK, _BODY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBI")
_END = b"\n"
_MASK = 0xA282EAD8
_NARROW, _NULL_ID = 1, 2
#: Bytes of text in a shard, about, and of frames in a file at most, but for its last frame. Few texts make shards of LEAST_BYTES.
SHARD_BYTES, ROLL_BYTES, LEAST_BYTES = 64 << 20, 256 << 20, 8 << 20
#: Ids that a reader hands on at a time, about.
BATCH_IDS = 1 << 20
INDEX = "shard bigint, file string, ordinal bigint, offset bigint, size bigint, doc_id bigint, n_tokens bigint, before bigint"


class DamagedFrame(ValueError):
    """A frame whose length or body doesn't match its checksum."""


def body_head(body: bytes) -> tuple[int | None, int, int]:
    """Document id, flags and number of ids of a body."""
    doc_id, flags, n = _BODY.unpack_from(body)
    return None if flags & _NULL_ID else doc_id, flags, n


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, compress: zstandard.ZstdCompressor) -> bytes:
    """One record, without its end mark."""
    narrow = not len(ids) or int(ids.max()) < 65536
    flags = _NARROW * narrow | _NULL_ID * (doc_id is None)
    body = _BODY.pack(doc_id or 0, flags, len(ids)) + compress.compress(ids.astype("<u2" if narrow else ID).tobytes())
    head = _LENGTH.pack(len(body))
    return b"".join([head, _CHECK.pack(masked(head)), body, _CHECK.pack(masked(body))])


def bodies(shard: bytes | memoryview) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(offset, size with the end mark, body, the body's checksum as stored) of each frame; the lengths' checksums are verified."""
    at, view = 0, memoryview(shard).cast("B")
    while at < len(shard):
        head = bytes(view[at : at + 8])
        if len(head) < 8 or view[at + 8 : at + 12] != _CHECK.pack(masked(head)):
            raise DamagedFrame(f"length at byte {at}")
        size = 8 + 4 + _LENGTH.unpack(head)[0] + 4 + 1
        if at + size > len(shard):
            raise DamagedFrame(f"cut off at byte {at}")
        yield at, size, bytes(view[at + 12 : at + size - 5]), bytes(view[at + size - 5 : at + size - 1])
        at += size


def parse(body: bytes, check: bytes | None, expand: zstandard.ZstdDecompressor) -> tuple[int | None, np.ndarray]:
    """The document's id and its token ids; check: the body's checksum as stored, to be verified."""
    if check is not None and check != _CHECK.pack(masked(body)):
        raise DamagedFrame("body")
    doc_id, flags, n = body_head(body)
    kind = np.dtype("<u2") if flags & _NARROW else ID
    ids = np.frombuffer(expand.decompress(body[_BODY.size :], max_output_size=n * kind.itemsize), dtype=kind) if n else np.zeros(0, ID)
    return doc_id, ids.astype(ID)


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), dealt out by ranges of ids into shards of bounded bytes, and sorted."""
    own = [F.col("id").asc_nulls_first(), F.col("own"), F.col("part")]
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-size // SHARD_BYTES), min(tasks, -(-size // LEAST_BYTES)))
    rows = rows.withColumn("own", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    return rows.repartitionByRange(shards, *own).sortWithinPartitions(*own).select("id", "text")


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id and writes the shards under path, in ascending order of ids."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, compress, end = encoder(tokenizer), zstandard.ZstdCompressor(level=1), np.array([end_id], dtype=ID).tobytes()
        k, written = 0, 0
        for batch in (part for whole in batches for part in slices(whole)):
            rolls, frames = [], []
            for i, x in zip(batch.column(0).to_pylist(), e.encode_batch(text_list(batch.column(1))), strict=True):
                frames.append(frame(i, np.frombuffer(x + end, dtype=ID), compress))
                rolls.append(written // ROLL_BYTES)
                written += len(frames[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(rolls, pa.int32()), pa.array(range(k, k + len(frames)), pa.int64()), pa.array(frames, pa.binary())], names=["roll", "k", "frame"])
            k += len(frames)

    framed = _ranges(docs, id_col, text_col).mapInArrow(records, "roll int, k bigint, frame binary").sortWithinPartitions("roll", "k")
    framed.select("roll", F.col("frame").cast("string").alias("frame")).write.partitionBy("roll").option("lineSep", _END.decode()).text(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, file, content) of the shards under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length bigint, content binary").load(f"{path}/roll=*")
    name = r"(roll=(\d+)/part-(\d+)-[^/]*?[-.]c(\d+)[^/]*)$"
    task, roll, count = (F.regexp_extract("path", name, k).cast("bigint") for k in (3, 2, 4))
    return files.select((F.shiftleft(task, 39) + F.shiftleft(roll, 27) + count).alias("shard"), F.regexp_extract("path", name, 1).alias("file"), "content")


def _found(spark: SparkSession, path: str) -> bool:
    """Whether there is a shard: an empty table leaves none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/roll=*")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each frame of the shards, from one pass that leaves the ids alone; before: the ids of the shard's earlier frames."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                out, before = [], 0
                for k, (offset, size, body, _) in enumerate(bodies(memoryview(content.as_buffer()))):
                    doc_id, _, n = body_head(body)
                    out.append((shard, file, k, offset, size, doc_id, n, before))
                    before += n
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "file" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    return _shards(spark, path).mapInArrow(rows, INDEX) if _found(spark, path) else spark.createDataFrame([], INDEX)


def _columns(frames: list[tuple[int, int, int | None, int, np.ndarray]], digest: bool) -> pa.RecordBatch:
    """frames: (shard, ordinal, doc_id, before, ids)."""
    out = {name: pa.array([f[k] for f in frames], pa.int64()) for k, name in enumerate(("shard", "ordinal", "doc_id", "before"))}
    if digest:
        out |= {"n_tokens": pa.array([len(f[4]) for f in frames], pa.int64()), "ids_crc32": pa.array([zlib.crc32(f[4].tobytes()) for f in frames], pa.int64())}
    else:
        out["ids"] = pa.array([f[4].astype(np.int64) for f in frames], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(out)


def _schema(digest: bool) -> str:
    return "shard bigint, ordinal bigint, doc_id bigint, before bigint, " + ("n_tokens bigint, ids_crc32 bigint" if digest else "ids array<bigint>")


def _batches(frames: Iterator[tuple[int, int, int | None, int, np.ndarray]], digest: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for f in frames:
        held.append(f)
        size += len(f[4])
        if size >= BATCH_IDS:
            yield _columns(held, digest)
            held, size = [], 0
    if held:
        yield _columns(held, digest)


def read_all(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """shard, ordinal, doc_id, before, ids (with digest: n_tokens and ids_crc32) of every frame, in one pass that verifies every checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()

        def frames() -> Iterator[tuple[int, int, int | None, int, np.ndarray]]:
            for batch in batches:
                for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    before = 0
                    for k, (_, _, body, check) in enumerate(bodies(memoryview(content.as_buffer()))):
                        doc_id, ids = parse(body, check, expand)
                        yield shard, k, doc_id, before, ids
                        before += len(ids)

        yield from _batches(frames(), digest)

    if not _found(spark, path):
        return spark.createDataFrame([], _schema(digest))
    return _shards(spark, path).select("shard", "content").mapInArrow(read, _schema(digest))


def read_frames(path: str, index: DataFrame, digest: bool = False) -> DataFrame:
    """The same for the frames that the rows of index name, as a shuffled reader's sample of them, where those rows are.

    Each task opens the files that its rows name and reads their ranges; no shard is read whole, and no content moves.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        expand = zstandard.ZstdDecompressor()
        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

        def frames() -> Iterator[tuple[int, int, int | None, int, np.ndarray]]:
            name, open_file = None, None
            for batch in batches:
                for shard, file, ordinal, offset, size, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != name:
                        if open_file is not None:
                            open_file.close()
                        name, open_file = file, system.open_input_file(os.path.join(base, file))
                    ((_, _, body, check),) = bodies(open_file.read_at(size, offset))
                    doc_id, ids = parse(body, check, expand)
                    yield shard, ordinal, doc_id, before, ids

        yield from _batches(frames(), digest)

    return index.select("shard", "file", "ordinal", "offset", "size", "before").mapInArrow(read, _schema(digest))


def shard_starts(index: DataFrame) -> DataFrame:
    """(shard, base): the ids of all earlier shards. The running sum is over one row for each shard."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def with_start(frames: DataFrame, index: DataFrame) -> DataFrame:
    """frames with start: the ids of all documents before each, in the order of the files."""
    return frames.join(shard_starts(index), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes path/shards and path/index, and returns the index."""
    spark = docs.sparkSession
    write_shards(docs, f"{path}/shards", tokenizer, end_id, id_col, text_col)
    build_index(spark, f"{path}/shards").write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    index = write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    frames = with_start(read_all(spark, f"{path}/shards", digest=True), index)
    return frames.select("doc_id", "start", "n_tokens", "ids_crc32")
