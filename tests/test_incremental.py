"""Kept results: new, changed, failed and vanished inputs, and jobs that die."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import incremental


class Maker:
    def __init__(self):
        self.asked: list[list] = []

    def __call__(self, todo):
        self.asked.append(sorted((r.k, r.x) for r in todo.collect()))
        return todo.where("x <> 'none'").select("k", F.upper("x").alias("y"), F.when(F.col("x") == "bad", F.lit("failed")).alias("error"))


def _inputs(spark, rows):
    return spark.createDataFrame(rows, "k long, x string").withColumn("fingerprint", F.md5(F.col("x").cast("binary")))


def test_only_new_or_changed_inputs(spark, tmp_path):
    make, path = Maker(), str(tmp_path / "kept")
    run = lambda rows, settings="": sorted(tuple(r) for r in incremental.kept(_inputs(spark, rows), ["k"], path, make, settings, "error IS NOT NULL").collect())
    first = [(1, "a"), (2, "b"), (3, "none"), (3, "none")]
    assert run(first) == [(1, "A", None), (2, "B", None)] and make.asked.pop() == [(1, "a"), (2, "b"), (3, "none")]
    assert run(first) == [(1, "A", None), (2, "B", None)] and not make.asked
    assert run([(1, "a"), (2, "c"), (4, "bad")]) == [(1, "A", None), (2, "C", None), (4, "BAD", "failed")] and make.asked.pop() == [(2, "c"), (4, "bad")]
    assert run([(2, "b"), (4, "bad")]) == [(2, "B", None), (4, "BAD", "failed")] and make.asked.pop() == [(4, "bad")]  # a failure is tried again
    assert run([(1, "a")], "other") == [(1, "A", None)] and make.asked.pop() == [(1, "a")]
    assert run([]) == []


def test_a_job_that_dies_is_done_again(spark, tmp_path):
    path, make = str(tmp_path / "kept"), Maker()

    def dies(todo):
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        incremental.kept(_inputs(spark, [(1, "a")]), ["k"], path, dies)
    # rows without the table of their inputs don't count
    incremental.kept(_inputs(spark, [(1, "a")]), ["k"], path, make).collect()
    batch = next((tmp_path / "kept").iterdir())
    (batch / "inputs" / "_SUCCESS").unlink()
    got = incremental.kept(_inputs(spark, [(1, "a"), (2, "b")]), ["k"], path, make).collect()
    assert sorted((r.k, r.y) for r in got) == [(1, "A"), (2, "B")] and make.asked == [[(1, "a")], [(1, "a"), (2, "b")]]
