"""What the corpus operators share: tables, the shared folder, maps over Arrow batches, and deterministic samples."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}
#: A Python worker holds so many rows, or bytes, of a batch as Python objects at a time, or one row.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20

#: (values of the first column, as Python objects) to new columns, one Arrow array each.
Transform = Callable[[pa.Array], list[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A folder of our own only where that is unset in local mode; elsewhere an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="strata-", dir=os.environ.get("TMPDIR"))
    return _OWN_DIRS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder. What is written there goes with drop(), or when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(lambda: [drop(s, p) for p, s in list(_WRITTEN.items())])
    _WRITTEN[path] = spark
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a path of fresh_path(), on whatever file system it is; one that is gone already is fine."""
    _WRITTEN.pop(path, None)
    with contextlib.suppress(Exception):  # the driver may be ending, and its JVM with it
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table, so that a lost executor costs no more than its own tasks."""
    return materialized(df, label)[0]


def materialized(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same, and the table's path, for drop() once nothing reads it any more."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces that are small as Python objects, as texts may be very long: by rows, then by bytes."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        count = max(1, -(-part.nbytes // most))
        step = max(1, -(-part.num_rows // count))
        for k in range(0, part.num_rows, step):
            yield part.slice(k, step)


def with_columns(rows: DataFrame, value: Column, keep: dict[str, Column], added: str, transform: Callable[[], Transform]) -> DataFrame:
    """The columns in keep, and those that a transform of value gives (their schema is added); a map without a shuffle.

    transform() is called in the worker, once for each partition. The columns in keep may have any names but those in added.
    """
    new = T.StructType.fromDDL(added)
    clash = {f.name for f in new.fields} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are what the operator adds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = transform()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *apply(part.column(0))], names=names)

    chosen = rows.select(value.alias("value"), *(c.alias(name) for name, c in keep.items()))
    schema = T.StructType([*chosen.schema.fields[1:], *new.fields])
    names = schema.names
    return chosen.mapInArrow(run, schema)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name that an operator adds beside it can clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def text_list(values: pa.Array) -> list[str]:
    """Python strings, null as empty. Bytes that aren't UTF-8 become replacement characters."""
    try:
        return [x or "" for x in values.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in values.cast(pa.binary()).to_pylist()]


def hash_bound(ids: DataFrame, column: str, rows: int) -> int | None:
    """The largest xxhash64 among the `rows` smallest of the column: rows up to it are a sample of about that size that any run repeats. None for an empty table."""
    h = F.xxhash64(F.col(column).cast("string"))
    return ids.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
