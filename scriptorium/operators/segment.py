"""Segmentation of positioned lines into columns and entries: gaps and islands by scans in reading order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crop_box, polygon_box
from ..functions.text import entry_id
from .numbering import numbered_in_order
from .scan import LIMIT, heavy_keys, quantiles, same_keys, scanned
from .storage import stored

CONFIDENCE = 0.5
GAP_MULTIPLIER = 2.0


def ocr_lines(results: DataFrame, keys: Sequence[str] = (), least: float = CONFIDENCE) -> DataFrame:
    """Engine results (parallel arrays dt_polys, rec_texts, rec_scores) as lines: keys, seq, bbox, text, confidence.

    The arrays are paired up to the shortest."""
    n = F.least(F.size("dt_polys"), F.size("rec_texts"), F.size("rec_scores"))
    zipped = F.slice(F.arrays_zip("dt_polys", "rec_texts", "rec_scores"), 1, n)
    rows = results.where(n > 0).select(*keys, F.posexplode(zipped).alias("seq", "x"))
    return rows.where(F.col("x.rec_scores") >= least).select(*keys, "seq", polygon_box(F.col("x.dt_polys")).alias("bbox"), F.col("x.rec_texts").alias("text"), F.col("x.rec_scores").alias("confidence"))


def split_columns(lines: DataFrame, width) -> DataFrame:
    """column: L for lines centred left of the middle, else R. width: a number or a column."""
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    return lines.withColumn("column", F.when((F.col("bbox.x_min") + F.col("bbox.x_max")) / 2 < w / 2, "L").otherwise("R"))


_ORDER = ("bbox.y_min", "bbox.x_min", "seq")


def reading_order(lines: DataFrame, keys: Sequence[str], heavy: DataFrame | None = None) -> DataFrame:
    """order: the line's place within keys, from 0, by y, x and input number; gap: from the line before to this one, null
    for the first. heavy: keys too large for a task (see operators.scan); without keys no task sees all lines."""
    rows = lines.withColumn("_bottom", F.col("bbox.y_max"))
    rows = scanned(rows, keys, _ORDER, place="order", before={"_above": "_bottom"}, heavy=heavy)
    return rows.withColumn("order", F.col("order").cast("int")).withColumn("gap", F.col("bbox.y_min") - F.col("_above")).drop("_bottom", "_above")


def gap_stats(lines: DataFrame, keys: Sequence[str], multiplier: float = GAP_MULTIPLIER, heavy: DataFrame | None = None) -> DataFrame:
    """Per key: median gap, median absolute deviation, the limit of a boundary, left margin and indent quartile."""
    gaps = lines if "gap" in lines.columns else reading_order(lines, keys, heavy)
    gaps = gaps.select(*keys, "gap", F.col("bbox.x_min").alias("x"))
    mid = quantiles(gaps, keys, {"median_gap": ("gap", 0.5)}, heavy, [F.min("x").alias("left_margin"), F.count(F.lit(1)).alias("n_lines")])
    mid = mid.withColumn("median_gap", F.coalesce("median_gap", F.lit(0.0)))
    both = same_keys(gaps, mid, keys, "inner") if keys else gaps.join(F.broadcast(stored(mid, "medians")))  # without keys: one row
    off = both.withColumn("off", F.abs(F.col("gap") - F.col("median_gap"))).withColumn("indent", F.col("x") - F.col("left_margin"))
    out = quantiles(off, keys, {"mad_gap": ("off", 0.5), "indent_q1": ("indent", 0.25)}, heavy, [F.first(c).alias(c) for c in ("median_gap", "left_margin", "n_lines")])
    out = out.withColumn("mad_gap", F.coalesce("mad_gap", F.lit(0.0)))
    return out.withColumn("limit", F.col("median_gap") + multiplier * F.col("mad_gap")).select(*keys, "median_gap", "left_margin", "mad_gap", "indent_q1", "n_lines", "limit")


def entry_numbers(lines: DataFrame, keys: Sequence[str], multiplier: float = GAP_MULTIPLIER, rows: int = LIMIT) -> DataFrame:
    """lines with order and gap, and entry_no: from 0 within keys; a new entry begins where the gap exceeds median + multiplier * deviation.

    Lines are sorted once for order and gap, which are stored, and once for the numbers; keys of more than so many rows
    are sorted in parts."""
    heavy = heavy_keys(lines, keys, rows)
    placed = stored(reading_order(lines, keys, heavy), "lines")
    limits = gap_stats(placed, keys, multiplier, heavy).select(*keys, "limit")
    starts = F.coalesce((F.col("gap") > F.col("limit")).cast("int"), F.lit(0))
    known = (same_keys(placed, limits, keys, "inner") if keys else placed.join(F.broadcast(limits))).withColumn("starts", starts)
    return scanned(known, keys, ["order"], sums={"entry_no": "starts"}, heavy=heavy).withColumn("entry_no", F.col("entry_no").cast("int")).drop("starts", "limit")


def union_box(rows: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """The box around each group's boxes, its number of lines, and more aggregates."""
    low, high = (lambda c, f=f: f(f"bbox.{c}").alias(c) for f in (F.min, F.max))
    return rows.groupBy(*by).agg(F.struct(low("x_min"), low("y_min"), high("x_max"), high("y_max")).alias("bbox"), F.count(F.lit(1)).alias("n_lines"), *more)


def segment_entries(lines: DataFrame, page: Sequence[str] = (), multiplier: float = GAP_MULTIPLIER, rows: int = LIMIT) -> DataFrame:
    """Entries of each page, left column first: page keys, entry_id, column, entry_no, bbox, lines in reading order."""
    keys = [*page, "column"]
    numbered = entry_numbers(lines, keys, multiplier, rows)
    listed = F.array_sort(F.collect_list(F.struct("order", "bbox", "text", "confidence"))).alias("lines")
    return union_box(numbered, [*keys, "entry_no"], listed).withColumn("entry_id", entry_id("column", "entry_no"))


def in_page_order(entries: DataFrame, page: Sequence[str] = ()) -> DataFrame:
    """place: the entry's number on its page from 0, all of the left column before the right one."""
    return numbered_in_order(entries, ["column", "entry_no"], page, "place")


def crop_boxes(entries: DataFrame, width, height, pad: int = 20) -> DataFrame:
    w, h = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (width, height))
    return entries.withColumn("crop", crop_box("bbox", w, h, pad))
