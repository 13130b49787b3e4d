"""Tables written between the steps of a long plan, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def _clear() -> None:
    """Deletes what was written, when the driver ends."""
    for path, spark in _WRITTEN.items():
        with contextlib.suppress(Exception):  # its JVM may be ending too
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that the cluster shares; what is written there goes when the driver ends.

    The folder is spark.checkpoint.dir; one of our own only where that is unset in local mode, elsewhere an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="strata-", dir=os.environ.get("TMPDIR"))
        base = _OWN[app]
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read again: a lost executor costs its tasks, and later steps plan on a short lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
