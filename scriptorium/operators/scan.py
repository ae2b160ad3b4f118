"""Scans and quantiles over keys of any size: places, running sums, the row before, medians. No task sees a whole large key.

Rows of a large key are dealt to range parts in its order; each part is scanned by itself, and what the parts before
hold (a number of rows, sums, the last row) is carried into it. There is at most one such carried row for a part, as
only the key that a part begins with can have begun before. Keys of up to LIMIT rows are scanned by plain windows; the
result is the same. Without key columns all rows are one large key.

Null keys are a key. Rows that are equal in the order may stand in any order among each other, the same one for all
results of a call. An empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Rows of a key that one task may scan. It affects the plan only.
LIMIT = 100_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """left joined with right where the keys are equal, null being equal to null; the keys of left stay."""
    mark = uuid.uuid4().hex
    renamed = right.select(*(F.col(f"`{c}`").alias(f"{c}_{mark}" if c in keys else c) for c in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}_{mark}`"))
    return left.join(renamed, on, how).drop(*(f"{k}_{mark}" for k in keys))


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> DataFrame | None:
    """The keys with more than limit rows, stored; None if there is none. Without key columns there is nothing to tell apart."""
    if not keys:
        return None
    found = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).drop("n"), "heavy")
    return None if found.isEmpty() else found


def _by_windows(df: DataFrame, keys, by, place, sums, before) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*by)
    to_here = own.rowsBetween(Window.unboundedPreceding, 0)
    new = [F.row_number().over(own).cast("long") - 1] * bool(place)
    new = [c.alias(place) for c in new] + [F.sum(x).over(to_here).alias(n) for n, x in sums.items()] + [F.lag(c).over(own).alias(n) for n, c in before.items()]
    return df.select("*", *new)


def _by_parts(df: DataFrame, keys, by, place, sums, before) -> DataFrame:
    mark = uuid.uuid4().hex
    part, number = f"part_{mark}", f"number_{mark}"
    s, b = ({n: f"{kind}{i}_{mark}" for i, n in enumerate(x)} for kind, x in (("sum", sums), ("last", before)))
    own = Window.partitionBy(part, *keys).orderBy(*by)
    to_here = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.repartitionByRange(*keys, *by).withColumn(part, F.spark_partition_id())
    # values are wrapped, so that a null one differs from no row at all
    own_values = [F.sum(x).over(to_here).alias(s[n]) for n, x in sums.items()] + [F.lag(F.struct(F.col(c).alias("x"))).over(own).alias(b[n]) for n, c in before.items()]
    rows = stored(rows.select("*", F.row_number().over(own).cast("long").alias(number), *own_values), "parts")
    ends = rows.groupBy(part, *keys).agg(F.max(number).alias("n"), *(F.max_by(s[n], number).alias(s[n]) for n in sums), *(F.max_by(F.struct(F.col(c).alias("x")), number).alias(b[n]) for n, c in before.items()))
    of_key = Window.partitionBy(*keys).orderBy(part)
    earlier = of_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(part, *keys, F.sum("n").over(earlier).alias("n"), *(F.sum(s[n]).over(earlier).alias(f"c{s[n]}") for n in sums), *(F.lag(b[n]).over(of_key).alias(f"c{b[n]}") for n in before))
    carried = carried.where("n IS NOT NULL").withColumnRenamed("n", f"c{number}")  # a row for each part at most
    out = same_keys(rows, F.broadcast(carried), [part, *keys], "left")
    new = [(F.col(number) - 1 + F.coalesce(F.col(f"c{number}"), F.lit(0))).alias(place)] if place else []
    # a sum is null until its first value
    new += [F.coalesce(F.col(s[n]) + F.col(f"c{s[n]}"), F.col(s[n]), F.col(f"c{s[n]}")).alias(n) for n in sums]
    new += [F.coalesce(b[n], f"c{b[n]}")["x"].alias(n) for n in before]
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *new)


def scanned(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], place: str | None = None, sums: Mapping[str, Column | str] | None = None, before: Mapping[str, str] | None = None, heavy: DataFrame | None = None
) -> DataFrame:
    """df with, in order of by within the keys: place (from 0), running sums (name: summand) and values of the row before
    (name: column). heavy: the keys to be scanned by parts (see heavy_keys); without key columns everything is."""
    args = (list(by), place, dict(sums or {}), dict(before or {}))
    if not keys:
        return _by_parts(df, [], *args)
    if heavy is None:
        return _by_windows(df, keys, *args)
    light = _by_windows(same_keys(df, heavy, keys, "left_anti"), keys, *args)
    return light.unionByName(_by_parts(same_keys(df, heavy, keys, "left_semi"), keys, *args))


def _selected(df: DataFrame, keys: Sequence[str], name: str, column: str, q: float) -> DataFrame:
    """The quantile by ranks: distinct values with their counts, which map-side aggregation brings down, scanned in order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranked = stored(scanned_by_parts(counts, keys, ["x"], {"upto": "n"}), "ranked")
    total = ranked.groupBy(*keys).agg(F.max("upto").alias("total"))
    at = (F.col("total") - 1) * F.lit(q)
    holds = lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))
    near = same_keys(ranked, total, keys, "inner") if keys else ranked.join(F.broadcast(total))
    near = near.where(holds(F.floor(at)) | holds(F.ceil(at)))
    low, high = (F.max(F.when(holds(f(at)), F.col("x"))) for f in (F.floor, F.ceil))
    found = near.groupBy(*keys, "total").agg(low.alias("low"), high.alias("high"))
    # as the built-in function does it
    mid = F.when(F.floor(at) == F.ceil(at), F.col("low")).otherwise((F.ceil(at) - at) * F.col("low") + (at - F.floor(at)) * F.col("high"))
    return found.select(*keys, mid.cast("double").alias(name))


def scanned_by_parts(df: DataFrame, keys: Sequence[str], by: Sequence[str], sums: Mapping[str, Column | str]) -> DataFrame:
    return _by_parts(df, list(keys), list(by), None, dict(sums), {})


def quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], heavy: DataFrame | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """keys, for each name the exact quantile q of a column, between two values by their distance: wanted[name] = (column, q),
    and more aggregates.

    Nulls don't count; null where a key has nothing else. heavy: the keys whose values are ranked by a distributed scan
    instead of being held by one task; without key columns everything is."""
    percentiles = [F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()]
    if keys and heavy is None:
        return df.groupBy(*keys).agg(*percentiles, *more)
    hot = same_keys(df, heavy, keys, "left_semi") if keys else df
    out = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *more).where("rows > 0").drop("rows")
    names = [c for c in out.columns if c not in keys]
    for n, (c, q) in wanted.items():
        found = _selected(hot, keys, n, c, q)
        out = same_keys(out, found, keys, "left") if keys else out.join(F.broadcast(found), how="left")
    out = out.select(*keys, *wanted, *names)
    return out.unionByName(same_keys(df, heavy, keys, "left_anti").groupBy(*keys).agg(*percentiles, *more)) if keys else out
