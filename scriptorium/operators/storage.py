"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Unset on a local master, a temporary one is set."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        there = got.get() if got.isDefined() else None
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and outlives lost executors.

    The files go when the session's JVM ends, or by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    for kept in _open:
        kept.append(out)
    return out


#: Of each call of a settled function that is running: the tables stored meanwhile.
_open: list[list[DataFrame]] = []


def settled(f):
    """f (giving a table), its result stored; all tables stored on the way go as soon as it is."""

    @wraps(f)
    def run(*args, **kwargs):
        _open.append([])
        try:
            out = f(*args, **kwargs)
        finally:
            made = _open.pop()
        out = stored(out, f.__name__)
        discard(*made)
        return out

    return run


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        fs, at = _files(df.sparkSession, df._stored)
        fs.delete(at, True)
