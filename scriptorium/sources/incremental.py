"""Results that are kept and added to: only inputs that are new or changed are worked on.

A folder holds batches. Each is the rows that were made of some inputs, and then a table of these inputs: key and fingerprint (of
content and settings). A batch counts when that table is finished, and its name is a digest of its inputs, so a job that
dies, or the same delivery again, writes the same batch anew and nothing twice. What is read are the rows of the inputs
as they are now: older rows of a changed input stay where they are, unread.

Defined cases: an input that gives no rows is done as well. One that fails (see failed) is tried again. Equal keys with
different fingerprints are inputs of their own; equal rows are one. Without inputs nothing is made."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import stored
from .writers import exists


def _batches(spark: SparkSession, path: str) -> list[str]:
    """The finished ones, by name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(n for n in names if n.startswith("batch-") and exists(spark, f"{path}/{n}/inputs/_SUCCESS"))


def _read(spark: SparkSession, path: str, batches: Sequence[str], what: str) -> DataFrame:
    return spark.read.parquet(*(f"{path}/{b}/{what}" for b in batches))


def kept(inputs: DataFrame, key: Sequence[str], path: str, make: Callable[[DataFrame], DataFrame], settings: str = "", failed: str | None = None) -> DataFrame:
    """inputs: key columns, fingerprint, and what make needs. make gives rows with the key columns for the inputs it gets.

    Gives the rows of all inputs, made now or before. failed: a condition on rows whose inputs aren't done."""
    spark = inputs.sparkSession
    name = [*key, "fingerprint"]
    now = inputs.withColumn("fingerprint", F.md5(F.concat(F.coalesce("fingerprint", F.lit("")), F.lit("/" + settings)).cast("binary")))
    now = stored(now.dropDuplicates(name), "inputs")
    batches = _batches(spark, path)
    todo = stored(now.join(_read(spark, path, batches, "inputs"), name, "left_anti"), "todo") if batches else now
    if not todo.isEmpty():
        digest = F.xxhash64(*name)
        sums = todo.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("a"), F.sum(F.pmod(digest, F.lit(2**31 - 1))).alias("b")).first()
        batch = f"batch-{len(batches):06d}-{sums.n}-{sums.a % 2**64:016x}-{sums.b}"
        made = make(todo).join(todo.select(name), [*key])
        made.write.mode("overwrite").parquet(f"{path}/{batch}/rows")
        rows = spark.read.parquet(f"{path}/{batch}/rows")
        done = todo.select(name)
        if failed:
            done = done.join(rows.where(failed).select(name), name, "left_anti")
        done.write.mode("overwrite").parquet(f"{path}/{batch}/inputs")
        batches = [*batches, batch]
    if not batches:
        return make(now)
    rows = _read(spark, path, batches, "rows")
    current = now.select(name)
    if failed:  # of an input that failed, only the last try
        last = F.max("batch").alias("batch")
        of = rows.withColumn("batch", F.regexp_extract(F.input_file_name(), "batch-([0-9]{6})-", 1))
        rows = of.join(of.groupBy(*name).agg(last), [*name, "batch"]).drop("batch")
    return rows.join(current, name).drop("fingerprint")
