"""The provenance container: a signed manifest, track and chunk tables, and the tracks' bytes in one file.

Layout, all integers little-endian: magic, u32 version; in version 2 sections of (u32 type, u64 length, bytes) in any order, in version 1
a u64 length, the manifest, and data to the end. A chunk record without a pts holds the least signed integer in its place; it
becomes NULL here and nowhere else.

`spark.read.format("provenance").option("table", ...)` reads manifests, tracks, chunks, sections or errors. With mode permissive a file
that can't be read has its one row in errors and none elsewhere; with failfast, the default, it fails the read. Writing takes the rows
of plans.works.containers: of each file a head, then its chunks. Files appear when the whole write commits. The option track
limits chunks to one track, and no other track's payload is read.
"""

from __future__ import annotations

import contextlib
import io
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# The format's magic, versions, section types and record shapes.
MAGIC = b"SMED"
V1, V2 = 1, 2
MANIFEST, TRACK_DATA, TRACK_TABLE, INDEX = 1, 2, 3, 4
NO_PTS = -(2**63)
RECORD = np.dtype([("track_id", "<u4"), ("chunk_index", "<u8"), ("pts", "<i8"), ("offset", "<u8"), ("size", "<u8")])

SCHEMAS = {
    "manifests": "path string, version int, manifest string, data_start bigint, data_length bigint, file_length bigint",
    "tracks": "path string, ord int, track_id bigint, codec string, total_chunks bigint, chunk_size bigint, index_count bigint",
    "chunks": "path string, track_id bigint, ord bigint, chunk_index bigint, pts bigint, offset bigint, size bigint, data binary",
    "sections": "path string, ord int, type bigint, length bigint, payload_offset bigint",
    "errors": "path string, error string",
}
MODES = ("failfast", "permissive")


class ContainerError(ValueError):
    """A file that isn't a container, or one that lacks what it must hold."""


@dataclass
class Container:
    version: int
    manifest: bytes
    data_start: int
    data_length: int
    #: (track_id, codec, total_chunks, chunk_size, index_count)
    tracks: list[tuple[int, str, int, int, int]] = field(default_factory=list)
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, RECORD))
    #: (type, length, payload offset)
    sections: list[tuple[int, int, int]] = field(default_factory=list)

    def check_range(self, offset: int, size: int) -> None:
        if offset < 0 or size < 0 or offset + size > 2**64 - 1:
            raise ContainerError("Invalid range")
        if offset + size > self.data_length:
            raise ContainerError("Requested data outside of track data section")

    def read(self, f: BinaryIO, offset: int, size: int) -> bytes:
        """A chunk by its place; shorter than size if the file is cut off."""
        self.check_range(offset, size)
        f.seek(self.data_start + offset)
        return f.read(size)

    def read_fixed(self, f: BinaryIO, number: int, chunk_size: int) -> bytes:
        return self.read(f, number * chunk_size, chunk_size)


def _exactly(f: BinaryIO, n: int) -> bytes:
    out = f.read(n)
    if len(out) < n:
        raise ContainerError("unexpected end of file")
    return out


def _track_table(body: bytes) -> list[tuple[int, str, int, int, int]]:
    f, out = io.BytesIO(body), []
    (count,) = struct.unpack("<I", _exactly(f, 4))
    for _ in range(count):
        track, size = struct.unpack("<II", _exactly(f, 8))
        codec = _exactly(f, size).decode()
        out.append((track, codec, *struct.unpack("<QQQ", _exactly(f, 24))))
    return out


def _chunk_table(body: bytes) -> np.ndarray:
    if len(body) < 8:
        raise ContainerError("unexpected end of file")
    (count,) = struct.unpack_from("<Q", body)
    if 8 + count * RECORD.itemsize > len(body):
        raise ContainerError("unexpected end of file")
    return np.frombuffer(body, RECORD, count, 8)


def open_container(f: BinaryIO) -> Container:
    """Reads all but the tracks' bytes. Of repeated sections the last counts; repeated indexes add up; unknown ones are skipped."""
    f.seek(0, os.SEEK_END)
    end = f.tell()
    f.seek(0)
    magic = f.read(4)
    if magic != MAGIC:
        raise ContainerError(f"Invalid magic: expected {list(MAGIC)}, got {list(magic)}")
    (version,) = struct.unpack("<I", _exactly(f, 4))
    if version == V1:
        (size,) = struct.unpack("<Q", _exactly(f, 8))
        manifest = _exactly(f, size)
        return Container(V1, manifest, f.tell(), end - f.tell())
    if version != V2:
        raise ContainerError("Unsupported version")
    out, manifest, data = Container(V2, b"", 0, 0), None, None
    indexes = []
    while len(kind := f.read(4)) == 4:  # up to 3 stray bytes at the end are nothing
        (section,), (length,) = struct.unpack("<I", kind), struct.unpack("<Q", _exactly(f, 8))
        at = f.tell()
        out.sections.append((section, length, at))
        if section == MANIFEST:
            manifest = _exactly(f, length)
        elif section == TRACK_TABLE:
            out.tracks = _track_table(_exactly(f, length))
        elif section == INDEX:
            indexes.append(_chunk_table(_exactly(f, length)))
        elif section == TRACK_DATA:
            data = (at, length)
        if length >= 2**63:
            raise ContainerError("section too long")
        f.seek(at + length)
    if manifest is None:
        raise ContainerError("Missing manifest section")
    if data is None:
        raise ContainerError("Missing track data section")
    out.manifest, (out.data_start, out.data_length) = manifest, data
    if indexes:
        out.index = np.concatenate(indexes)
    return out


def _section(kind: int, body: bytes) -> bytes:
    return struct.pack("<IQ", kind, len(body)) + body


def head(manifest: bytes, tracks: list[tuple[int, str, int, int]], index: list[tuple[int, int, int | None, int, int]]) -> bytes:
    """All of a version 2 container before its payload. tracks: (track_id, codec, total_chunks, chunk_size). index: (track_id, chunk_index, pts, offset, size)."""
    for track, _, total, _ in tracks:
        if sum(c[0] == track for c in index) != total:
            raise ContainerError(f"track {track} hasn't the chunks that its table says")
    if {c[0] for c in index} - {t[0] for t in tracks}:
        raise ContainerError("chunks of a track that the table lacks")
    records = np.zeros(len(index), RECORD)
    for k, (track, number, pts, at, size) in enumerate(index):
        records[k] = (track, number, NO_PTS if pts is None else pts, at, size)
    table = struct.pack("<I", len(tracks)) + b"".join(struct.pack("<II", t, len(c.encode())) + c.encode() + struct.pack("<QQQ", n, size, n) for t, c, n, size in tracks)
    sections = _section(MANIFEST, manifest) + _section(TRACK_TABLE, table) + _section(INDEX, struct.pack("<Q", len(records)) + records.tobytes())
    return MAGIC + struct.pack("<I", V2) + sections + struct.pack("<IQ", TRACK_DATA, sum(c[4] for c in index))


def to_bytes(manifest: bytes, tracks: list[tuple[int, str, int, int]], chunks: list[tuple[int, int, int | None, bytes]]) -> bytes:
    """A version 2 container. chunks: (track_id, chunk_index, pts, bytes), in payload order."""
    index, at = [], 0
    for track, number, pts, data in chunks:
        index.append((track, number, pts, at, len(data)))
        at += len(data)
    return head(manifest, tracks, index) + b"".join(c[3] for c in chunks)


def _head_of(row: Any) -> bytes:
    """The head that a head row of the sink's input stands for."""
    tracks = [(t["track_id"], t["codec"], t["total_chunks"], t["chunk_size"]) for t in row["tracks"]]
    return head(row["manifest"].encode(), tracks, [(c["track_id"], c["chunk_index"], c["pts"], c["offset"], c["size"]) for c in row["index"]])


def write_rows(rows: Iterator[Any], open_file: Callable[[str], BinaryIO]) -> list[str]:
    """Writes each file that the rows hold (a head, then its chunks in order) and returns their names."""
    names, out, left = [], None, 0
    for row in rows:
        if row["manifest"] is not None:
            if row["name"] in names[-1:]:
                raise ContainerError(f"several works are named {row['name']!r}")
            if left:
                raise ContainerError(f"{names[-1]}: {left} bytes of payload are missing")
            if out:
                out.close()
            names.append(row["name"])
            out, left = open_file(row["name"]), sum(c["size"] for c in row["index"])
            out.write(_head_of(row))
        elif out is None or row["name"] != names[-1]:
            raise ContainerError(f"{row['name']}: a chunk before its head")
        else:
            out.write(row["data"])
            left -= len(row["data"])
    if out:
        out.close()
    if left:
        raise ContainerError(f"{names[-1]}: {left} bytes of payload are missing")
    return names


def _signed(x: int) -> int:
    if x >= 2**63:
        raise ContainerError("a number beyond 63 bits")
    return int(x)


def rows(table: str, path: str, f: BinaryIO, mode: str = "failfast", track: int | None = None) -> Iterator[tuple[Any, ...]]:
    """The rows of one table of one container, in the order of SCHEMAS; track: chunks of that track only."""
    if table == "errors" or mode == "permissive":
        try:
            found = list(_rows("manifests", path, f, None)) + list(_rows("tracks", path, f, None)) if table == "errors" else list(_rows(table, path, f, track))
            for _ in _rows("chunks", path, f, None):  # every chunk stands inside the payload
                pass
        except (ContainerError, UnicodeDecodeError, struct.error) as e:
            found = [(path, str(e))] if table == "errors" else []
        else:
            found = [] if table == "errors" else found
        yield from found
    else:
        yield from _rows(table, path, f, track)


def _rows(table: str, path: str, f: BinaryIO, track_id: int | None) -> Iterator[tuple[Any, ...]]:
    c = open_container(f)
    if table == "manifests":
        f.seek(0, os.SEEK_END)
        yield path, c.version, c.manifest.decode(), c.data_start, c.data_length, f.tell()
    elif table == "tracks":
        for k, (track, codec, total, size, count) in enumerate(c.tracks):
            yield path, k, track, codec, _signed(total), _signed(size), _signed(count)
    elif table == "sections":
        for k, (kind, length, at) in enumerate(c.sections):
            yield path, k, kind, length, at
    else:
        for k, r in enumerate(c.index):
            if track_id is not None and r["track_id"] != track_id:
                continue
            offset, size, pts = _signed(r["offset"]), _signed(r["size"]), int(r["pts"])
            yield path, int(r["track_id"]), k, _signed(r["chunk_index"]), None if pts == NO_PTS else pts, offset, size, c.read(f, offset, size)


def parse_files(files: DataFrame, table: str, path_col: str = "path", data_col: str = "data", mode: str = "failfast") -> DataFrame:
    """A table of containers whose bytes are a column, as from spark.read.format("binaryFile"): any file system that Spark reads."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(SCHEMAS[table]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(rows(table, path, io.BytesIO(data.as_py()), mode))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return files.select(F.col(path_col), F.col(data_col)).where(F.col(data_col).isNotNull()).mapInArrow(run, SCHEMAS[table])


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "manifests")
        if self.table not in SCHEMAS:
            raise ValueError(f"unknown table {self.table!r}: one of {', '.join(SCHEMAS)}")
        self.mode, self.track = options.get("mode", "failfast").lower(), int(options["track"]) if "track" in options else None
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}: one of {', '.join(MODES)}")
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[_File]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names) if not n.startswith((".", "_"))]

    def read(self, partition: _File) -> Iterator[tuple[Any, ...]]:
        with open(partition.path, "rb") as f:
            yield from rows(self.table, partition.path, f, self.mode, self.track)


@dataclass
class _Wrote(WriterCommitMessage):
    """(temporary path, name) of a task's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceWriter):
    """Tasks write temporary files beside their targets; the commit moves them there, an abort deletes them."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")

    def write(self, iterator: Iterator[Any]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        made: dict[str, str] = {}

        def open_file(name: str) -> BinaryIO:
            if name in made or os.path.basename(name) != name or name in ("", ".", "..") or name.startswith((".", "_")):
                raise ContainerError(f"{name!r} isn't the name of a file of its own")
            made[name] = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp")
            return open(made[name], "wb")

        try:
            write_rows(iterator, open_file)
        except BaseException:
            self._delete(list(made.values()))
            raise
        return _Wrote([(tmp, name) for name, tmp in made.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if twice := {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set():
            self._delete([tmp for tmp, _ in files])
            raise ContainerError(f"several works are named {sorted(twice)[0]!r}")
        for tmp, name in files:
            os.replace(tmp, os.path.join(self.path, name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete([tmp for m in messages if m is not None for tmp, _ in m.files])

    @staticmethod
    def _delete(paths: list[str]) -> None:
        for p in paths:
            with contextlib.suppress(FileNotFoundError):
                os.remove(p)


class ProvenanceSource(DataSource):
    """Containers on a file system that all executors mount; elsewhere read with binaryFile and parse_files()."""

    @classmethod
    def name(cls) -> str:
        return "provenance"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "manifests")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProvenanceSource)
