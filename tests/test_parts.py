"""Folders of parts: order, appending, failures, names in any place."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import parts, readers

SCHEMA = "seq long, a string, `b c` string"


def _rows(n, first=0):
    return [(first + i, f'say "{i}"\tand\nmore' if i % 3 else None, "" if i % 2 else f"é{i}") for i in range(n)]


def _left(path) -> set[str]:
    return {p.name for p in Path(path).iterdir() if not p.name.startswith(".")}


@pytest.mark.parametrize("uri", [str, lambda p: f"file://{p}"])
def test_tsv_in_order_with_appended_batches(spark, tmp_path, uri):
    path = uri(tmp_path / "t")
    df = spark.createDataFrame(_rows(500), SCHEMA).repartition(7)
    parts.write_tsv(df, path, ["seq"])
    for batch in ("x", "x", None, None, "y"):
        parts.write_tsv(spark.createDataFrame(_rows(3, 500), SCHEMA), path, ["seq"], append=True, batch=batch)
    got = sorted(parts.read_tsv(spark, path).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(512))
    want = [(str(i), a or "", b) for i, a, b in [*_rows(500), *_rows(3, 500) * 4]]
    assert [tuple(r)[:3] for r in got] == want
    assert not any(n.startswith(("_writing", "_making")) for n in _left(tmp_path / "t"))
    parts.write_tsv(spark.createDataFrame(_rows(2), SCHEMA), path)
    assert parts.read_tsv(spark, path).count() == 2 and len(_left(tmp_path / "t")) <= 3


def test_spark_reads_the_parts_too(spark, tmp_path):
    parts.write_tsv(spark.createDataFrame(_rows(40), SCHEMA), str(tmp_path / "t"), ["seq"], drop=["seq"])
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True, multiLine=True, escape='"').count() == 40
    parts.write_json(spark.createDataFrame(_rows(40), SCHEMA), str(tmp_path / "j"), ["seq"])
    found = [x for f in sorted((tmp_path / "j").glob("*.json")) if not f.name.startswith("_") for x in json.loads(f.read_text())]
    assert [x["seq"] for x in found] == list(range(40)) and found[0] == {"seq": 0, "b c": "é0"}


def test_json_of_any_shape_in_small_parts(spark, tmp_path, monkeypatch):
    schema = "k long, l array<struct<x: string, y: double>>"
    rows = [(k, [("line\nbreak ],[", 0.5)] * (k % 3)) for k in range(100)]
    monkeypatch.setattr(parts, "ROWS", 7)
    monkeypatch.setattr(parts, "AT_ONCE", 3)
    path = str(tmp_path / "j")
    parts.write_json(spark.createDataFrame(rows, schema).coalesce(1), path, ["k"])
    got = sorted(parts.read_json(spark, path, schema).collect(), key=lambda r: r.place)
    assert [(r.k, [tuple(x) for x in r.l]) for r in got] == rows and [r.place for r in got] == list(range(100))


def test_parts_are_cut_by_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(parts, "ROWS", 7)
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, z))}) for a, z in ((0, 3), (3, 3), (3, 20), (20, 21))]
    got = [[x for b in part for x in b.column(0).to_pylist()] for part in parts._in_parts(iter(batches))]
    assert got == [list(range(0, 7)), list(range(7, 14)), list(range(14, 21))]
    assert list(parts._in_parts(iter([]))) == [] and list(parts._in_parts(iter(batches[1:2]))) == []


def test_a_failure_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    parts.write_tsv(spark.createDataFrame(_rows(5), SCHEMA), path, ["seq"])
    before = _left(path)
    bad = spark.createDataFrame(_rows(50), SCHEMA).repartition(4).withColumn("a", F.when(F.col("seq") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("a")))
    for append in (True, False):
        with pytest.raises(Exception, match="no"):
            parts.write_tsv(bad, path, append=append)
        assert _left(path) == before and parts.read_tsv(spark, path).count() == 5
    files = bad.select(F.concat(F.lit("d/"), F.col("seq").cast("string"), F.col("a")).alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="no"):
        parts.write_files(files.coalesce(1), str(tmp_path / "f"))
    assert not [p for p in (tmp_path / "f").rglob("*") if p.is_file()]


def test_empty_tables_and_absent_folders(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    parts.write_tsv(none, str(tmp_path / "t"), ["seq"])
    assert parts.read_tsv(spark, str(tmp_path / "t")).count() == 0
    parts.write_json(none, str(tmp_path / "j"))
    assert parts.read_json(spark, str(tmp_path / "j"), "seq long").count() == 0
    with pytest.raises(Exception, match="no parts"):
        parts.read_tsv(spark, str(tmp_path / "absent"))


def test_files_in_folders(spark, tmp_path):
    rows = [(f"{k % 3}/{k}.png", bytes([k])) for k in range(50)] + [("z.txt", None)]
    parts.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(5), f"file://{tmp_path}/f")
    assert readers.read_images(spark, f"{tmp_path}/f/*/*.png").count() == 50 and (tmp_path / "f/1/4.png").read_bytes() == b"\x04"
    assert (tmp_path / "f/z.txt").read_bytes() == b""
