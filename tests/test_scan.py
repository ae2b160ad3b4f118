"""Scans and quantiles by parts against plain Python."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import scan, segment
from scriptorium.operators.storage import stored

ROWS = 3_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(rng.choice(["a", "a", "a", "a", None, "b", "c"]), i, rng.choice([None, 1, 2, rng.randint(-50, 50)]), rng.choice([None, float(rng.randint(0, 20)), rng.random()])) for i in range(ROWS)]


def _by_key(rows, keys):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0] if keys else None, []).append(r)
    return out


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [10, 500, 1_000_000])
def test_scanned(spark, rows, keys, limit):
    df = spark.createDataFrame(rows, "k string, i long, n long, x double").repartition(5)
    heavy = scan.heavy_keys(df, keys, limit)
    assert (heavy is None) == (not keys or limit > ROWS)
    got = {r.i: r for r in scan.scanned(df, keys, ["i"], "place", {"upto": "n"}, {"was": "x"}, heavy).collect()}
    for part in _by_key(rows, keys).values():
        total, was = None, None
        for place, (_, i, n, x) in enumerate(part):
            total = total if n is None else n + (total or 0)
            assert (got[i].place, got[i].upto, got[i].was) == (place, total, was)
            was = x
    assert len(got) == ROWS


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_quantiles(spark, rows, keys, limit):
    df = spark.createDataFrame([*rows, ("none", -1, None, None)], "k string, i long, n long, x double")
    heavy = scan.heavy_keys(df, keys, limit)
    got = scan.quantiles(df, keys, {"mid": ("x", 0.5), "low": ("n", 0.25), "top": ("x", 1.0)}, heavy, [F.max("i").alias("last")]).collect()
    by = _by_key([*rows, ("none", -1, None, None)], keys)
    assert len(got) == len(by)
    for r in got:
        part = by[r.k if keys else None]
        x, n = sorted(v[3] for v in part if v[3] is not None), sorted(v[2] for v in part if v[2] is not None)
        assert r["last"] == max(v[1] for v in part)
        if not x:
            assert (r.mid, r.low, r.top) == (None, None, None)
            continue
        at = 0.25 * (len(n) - 1)
        assert r.mid == pytest.approx(statistics.median(x)) and r.top == x[-1]
        assert r.low == pytest.approx(n[int(at)] + (at % 1) * (n[min(int(at) + 1, len(n) - 1)] - n[int(at)]))


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "k string, i long, n long, _part int, number long")
    for keys in (["k"], []):
        assert scan.scanned(df, keys, ["i"], "place", {"s": "n"}, {"b": "n"}).count() == 0
        assert scan.quantiles(df, keys, {"m": ("n", 0.5)}).count() == 0
    df = spark.createDataFrame([("a", 2, 5, 7, 8), ("a", 1, None, 7, 8)], df.schema)
    got = scan.scanned(df, [], ["i"], "place", {"s": "n"}, {"b": "n"}).orderBy("i").collect()
    assert [(r.place, r.s, r.b, r._part, r.number) for r in got] == [(0, None, None, 7, 8), (1, 5, None, 7, 8)]


def test_one_value_in_all_rows(spark):
    df = spark.range(5_000).select(F.lit(3.5).alias("x"))
    assert scan.quantiles(df, [], {"m": ("x", 0.5)}).first().m == 3.5


def test_segments_of_a_large_page_are_those_of_windows(spark):
    rng = random.Random(3)
    boxes = [(p, i, (float(rng.randint(0, 90)), float(y := rng.randint(0, 4_000)), 5.0, y + 3.0), "t", 0.9) for p in (1, None) for i in range(400)]
    lines = spark.createDataFrame(boxes, "page long, seq long, bbox struct<x_min double, y_min double, x_max double, y_max double>, text string, confidence double")
    lines = segment.split_columns(lines, 100)
    plain, parts = (sorted(map(repr, segment.segment_entries(lines, ["page"], rows=n).collect())) for n in (10_000, 50))
    assert plain == parts and len(plain) > 10


def test_rows_of_a_key_are_scanned_in_parts(spark, monkeypatch):
    """What a window sees of the one key: a part of its rows, and a row for each part."""
    kept = []
    monkeypatch.setattr(scan, "stored", lambda df, name: kept.append(out := stored(df, name)) or out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan.scanned(spark.range(20_000).select(F.col("id").alias("i")), [], ["i"], "place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("i <> place").isEmpty()
    part = next(c for c in kept[0].columns if c.startswith("part_"))
    sizes = [r["count"] for r in kept[0].groupBy(part).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000
