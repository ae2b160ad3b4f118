"""Ten evaluated runs of one page, and a page's lines with its entries: counts, rates and confusions as published.

The files in fixtures are fixed values: published gold records, extractions, lines and figures, unchanged, as results
are to equal the published ones."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import functions as F

from scriptorium.operators import segment
from scriptorium.operators.storage import stored
from scriptorium.plans import reports
from scriptorium.sources.readers import read_tsv

HERE = Path(__file__).parent / "fixtures"


def test_runs(spark):
    want = json.loads((HERE / "runs/expected.json").read_text())
    read = lambda name, run: read_tsv(spark, str(HERE / f"runs/{name}.tsv")).drop("path").withColumn("run_id", F.lit(run))
    union = lambda frames: stored(reduce(lambda a, b: a.unionByName(b), frames), "runs")
    e = reports.evaluate(union([read("gold", r) for r in want]), union([read(r, r) for r in want]), ["run_id"])
    rows = {r.run_id: r.asDict() for r in e.counts.collect()}
    for df in (e.totals, e.rates):
        for r in df.collect():
            rows[r.run_id] |= r.asDict()
    found: dict[str, list] = {}
    for r in e.confusions.collect():
        found.setdefault(r.run_id, []).append([r.op, r.gt, r.ext, r.n])
    for run, w in want.items():
        got = rows[run]
        for k, v in w.items():
            if k == "confusions":
                assert sorted(found[run]) == v
            elif isinstance(v, str):
                assert f"{got[k]:.{len(v) - 2}f}" == v, (run, k)
            else:
                assert got[k] == v, (run, k)


# Published characters, substitutions, deletions, insertions and rates by field of two runs.
FIELDS = {
    "run_04": ["Headword_Phrase 337 46 0 3 0.1454", "POS 98 0 0 0 0.0000", "Translation_RU 576 0 17 0 0.0295", "Grammar_Notes 62 3 5 0 0.1290"],
    "run_05": ["Headword_Phrase 451 13 3 2 0.0399", "POS 123 0 0 0 0.0000", "Translation_RU 779 0 0 0 0.0000", "Grammar_Notes 69 0 0 0 0.0000"],
}


def test_field_table(spark):
    """The character report's last table, to the letter but for the blanks; and words replaced, dropped and added."""
    read = lambda name: read_tsv(spark, str(HERE / f"runs/{name}.tsv")).drop("path")
    for run, want in FIELDS.items():
        e = reports.evaluate(read("gold"), read(run))
        lines = "".join(reports.error_text(e)).split("\n")
        at = lines.index("ERROR RATES BY FIELD:")
        assert [" ".join(x.split()) for x in lines[at + 4 : at + 8]] == want
        if run == "run_05":
            assert json.loads("".join(reports.error_json(e)))["word_errors"] == {"substitutions": 14, "deletions": 0, "insertions": 0}


def test_page(spark):
    page = json.loads((HERE / "page.json").read_text())
    rows = [(i, tuple(r[:4]), r[4], r[5]) for i, r in enumerate(page["lines"])]
    lines = spark.createDataFrame(rows, "seq int, bbox struct<x_min: double, y_min: double, x_max: double, y_max: double>, text string, confidence double")
    got = segment.segment_entries(segment.split_columns(lines, float(page["width"]))).orderBy("column", "entry_no").collect()
    assert [[r.entry_id, r.n_lines, list(r.bbox)] for r in got] == page["entries"]
