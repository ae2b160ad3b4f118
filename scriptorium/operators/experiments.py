"""Comparison of runs: metrics keyed by run_id, next to a table of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, percent


def _shown(c: Column, other: str) -> Column:
    return F.coalesce(c, F.lit(other))


def compare_runs(variants: DataFrame, totals: DataFrame) -> DataFrame:
    """variants: run_id, label, seq. Each with its error rates as text, N/A where the run has none."""
    rate = lambda c: F.when(F.col(c).isNotNull(), F.concat(fixed(c, 4), F.lit(" ("), percent(c), F.lit(")")))
    return variants.join(totals, "run_id", "left").select("run_id", "label", "seq", _shown(rate("cer"), "N/A").alias("cer"), _shown(rate("wer"), "N/A").alias("wer")).orderBy("seq")


def ablation_table(variants: DataFrame, totals: DataFrame, counts: DataFrame) -> DataFrame:
    """variants: run_id, label, seq, has_image. Those with an image, with CER, WER and F1, ERROR where a run has none."""
    rows = variants.where("has_image").join(totals.select("run_id", "cer", "wer"), "run_id", "left").join(counts.select("run_id", "overall_f1"), "run_id", "left")
    number = lambda c, f: _shown(fixed(c, f), "ERROR").alias(c)
    return rows.select("run_id", "label", "seq", number("cer", 4), number("wer", 4), number("overall_f1", 3)).orderBy("seq")
