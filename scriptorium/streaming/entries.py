"""Streams of extracted records: files as they arrive, and running error rates by event time.

An addition: the batch operators themselves are used on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_text, ratio_or_zero
from ..schemas import JSON_RECORD


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of JSON-lines files that appear in a folder, with the time of their arrival."""
    return spark.readStream.schema(JSON_RECORD).option("maxFilesPerTrigger", files_per_trigger).json(folder).withColumn("arrived", F.current_timestamp())


def pair_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Pairs of gold and extracted texts: run_id, at, gold, extracted."""
    return spark.readStream.schema("run_id string, at timestamp, gold string, extracted string").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_errors(pairs: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Character error rates by run and event-time window. Rows later than `late` are left out, and so state stays small."""
    rows = pairs.withWatermark("at", late).select("run_id", "at", normalize_text("gold").alias("gt"), normalize_text("extracted").alias("ext"))
    sums = rows.groupBy(F.window("at", window).alias("w"), "run_id").agg(F.sum(F.length("gt")).alias("chars"), F.sum(F.levenshtein("gt", "ext")).alias("errors"))
    return sums.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "chars", "errors", ratio_or_zero("errors", "chars").alias("cer"))


def to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends finished rows to a folder until all files that are there are read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
