from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.similarity import similarity
from scriptorium.operators import experiments, images, layout, matching, metrics, segment
from scriptorium.plans import reports
from scriptorium.schemas import TSV_FIELDS

COLUMNS = "run_id string, seq long, " + ", ".join(f"{c} string" for c in TSV_FIELDS)


def sides(spark, n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    gold, other = [], []
    for run in ("a", "b"):
        heads = [word() for _ in range(n // 4)]
        for i in range(n):
            h = rng.choice(heads)
            gold.append((run, i, h, "word", rng.choice(["n", "v", ""]), f"{h} {word()}, {word()}", "", rng.choice(["", "note"])))
        for j, g in enumerate(rng.sample(gold[-n:], n - 10)):
            h = g[2] if rng.random() < 0.5 else g[2][:-1] + rng.choice("xyz")
            other.append((run, j, h, "word", g[4], g[5].replace("a", "e"), "", g[7]))
    make = lambda rows: spark.createDataFrame(rows, COLUMNS)
    return gold, other, make(gold), make(other)


def _norm(x):
    return x.strip().lower().replace("p", "р").replace(",", ";") if "p" in x else x.strip().lower().replace(",", ";")


def _greedy(gold, other):
    """The sequential assignment, straight from its definition."""
    out = {}
    for run in ("a", "b"):
        used = set()
        for g in (r for r in gold if r[0] == run):
            best, score = None, 0.0
            for e in (r for r in other if r[0] == run and r[1] not in used):
                h = similarity(_norm(g[2]), _norm(e[2]))
                if h >= 0.7:
                    s = 0.5 * h + 0.15 * similarity(_norm(g[4]), _norm(e[4])) + 0.35 * similarity(_norm(g[5]), _norm(e[5]))
                    if s > score:
                        best, score = e[1], s
            if best is not None:
                used.add(best)
                out[run, g[1]] = (best, round(score, 9))
    return out


def test_greedy_match_is_the_sequential_one(spark):
    gold, other, g, e = sides(spark)
    m = matching.match_records(g, e, ["run_id"]).collect()
    assert {(r.run_id, r.g_seq): (r.e_seq, round(r.overall, 9)) for r in m} == _greedy(gold, other)
    assert len({(r.run_id, r.e_seq) for r in m}) == len(m)


def _sequential(pairs: list[tuple]) -> set[tuple]:
    """Of (key, g, e, overall), what is taken record by record."""
    out, taken = set(), set()
    for key, g in sorted({p[:2] for p in pairs}):
        free = [(-o, e) for k, h, e, o in pairs if (k, h) == (key, g) and (k, e) not in taken and o > 0]
        if free:
            e = min(free)[1]
            taken.add((key, e))
            out.add((key, g, e))
    return out


@pytest.mark.parametrize("at_once", [1, 40, 1_000_000])
def test_assignment_in_rounds_and_at_once(spark, at_once):
    """Ties, zeros and chains, whether a key's pairs go in order at once or are brought down by rounds before."""
    rng = random.Random(5)
    pairs = [(k, g, e, rng.choice([0.0, 0.5, 0.5, 0.75, 0.9, rng.random()])) for k in range(6) for g in range(rng.randint(1, 25)) for e in rng.sample(range(30), rng.randint(0, 5))]
    df = spark.createDataFrame(pairs, "k int, g_seq long, e_seq long, overall double").repartition(3)
    assert {(r.k, r.g_seq, r.e_seq) for r in matching.greedy_match(df, ["k"], at_once).collect()} == _sequential(pairs)
    one = [(0, *p[1:]) for p in pairs if p[0] == 1]
    got = matching.greedy_match(spark.createDataFrame([p[1:] for p in one], "g_seq long, e_seq long, overall double"), (), at_once).collect()
    assert {(0, r.g_seq, r.e_seq) for r in got} == _sequential(one)


def test_chain_of_displaced_records(spark):
    """Each of 1,000 records prefers what the one before it gets."""
    pairs = [(0, g, e, 1.0 - 0.1 * (e == g)) for g in range(1_000) for e in (g - 1, g) if e >= 0]
    got = matching.greedy_match(spark.createDataFrame([p[1:] for p in pairs], "g_seq long, e_seq long, overall double")).collect()
    assert {(r.g_seq, r.e_seq) for r in got} == {(g, g) for g in range(1_000)}


def test_candidates_without_keys(spark):
    """Many records under one key: keys of several characters find the same pairs as all against all."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(matching.PAGE + 60)})
    other = sorted({w[: rng.randint(0, len(w))] + rng.choice("abxy") + w[rng.randint(0, len(w)) :] for w in rng.sample(words, 150)})
    g, e = (spark.createDataFrame([(w,) for w in ws], f"{s}_head string") for ws, s in ((words, "g"), (other, "e")))
    got = {(r.g_head, r.e_head) for r in matching.similar_heads(g, e).collect()}
    assert got == {(a, b) for a in words for b in other if similarity(a, b) >= 0.7}


def test_counts_add_up(spark):
    _, _, g, e = sides(spark, seed=3)
    found = reports.evaluate(g, e, ["run_id"])
    for r in found.counts.collect():
        assert r.missing_entries == found.missing.where(F.col("run_id") == r.run_id).count() and r.extra_entries == found.extra.where(F.col("run_id") == r.run_id).count()
        assert r.exact_matches + r.partial_matches + r.missing_entries <= r.total_gold
    for t, o in zip(found.totals.orderBy("run_id").collect(), found.rates.orderBy("run_id").collect(), strict=True):
        assert o.substitutions + o.deletions + o.insertions == t.char_errors and t.total_chars == o.total_chars
    by_field = found.fields.groupBy("run_id").agg(F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("n")).collect()
    assert {r.run_id: r.n for r in by_field} == {r.run_id: r.char_errors for r in found.totals.collect()}


def test_reports(spark, tmp_path):
    _, _, g, e = sides(spark, 20, seed=4)
    one = lambda df: df.where("run_id = 'a'").drop("run_id")
    made = reports.write_reports(reports.evaluate(one(g), one(e)), str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in made] == ["evaluation_report.txt", "evaluation_report_details.json", "character_error_report.txt", "character_error_report_details.json"]
    text = (tmp_path / "character_error_report.txt").read_text()
    assert "Character Error Rate (CER)" in text and "ERROR RATES BY FIELD" in text
    lines = text.split("\n")
    assert lines[lines.index("ERROR RATES BY FIELD:") + 2].split() == ["Field", "Chars", "Subs", "Dels", "Ins", "CER"]
    found = reports.evaluate(one(g), one(e))
    errors = json.loads((tmp_path / "character_error_report_details.json").read_text())
    assert list(errors) == ["cer", "wer", "total_chars", "total_words", "total_char_errors", "total_word_errors", "substitutions", "deletions", "insertions", "word_errors", "field_stats"]
    assert set(errors["word_errors"]) == {"substitutions", "deletions", "insertions"} and sum(errors["word_errors"].values()) == errors["total_word_errors"]
    assert sum(errors[f"{o}s"]["count"] for o in ("substitution", "deletion", "insertion")) == errors["total_char_errors"]
    top = errors["substitutions"]["most_common"]
    assert 0 < len(top) <= 30 and all(set(x) == {"from", "to", "count", "examples"} and len(x["examples"]) == x["count"] for x in top)
    assert set(top[0]["examples"][0]) == {"ground_truth", "extracted"} and [x["count"] for x in top] == sorted((x["count"] for x in top), reverse=True)
    assert all(set(x) == {"chars", "subs", "dels", "ins"} for x in errors["field_stats"].values())
    assert text.count("    Example: ") == sum(len(x["examples"]) for o in ("substitutions", "deletions", "insertions") for x in errors[o]["most_common"])
    details = json.loads((tmp_path / "evaluation_report_details.json").read_text())
    assert list(details) == ["metrics", "missing_entries", "extra_entries", "low_score_matches"] and len(details["missing_entries"]) == found.missing.count()
    assert (tmp_path / "evaluation_report_details.json").read_text() == json.dumps(details, ensure_ascii=False, indent=2)
    assert (tmp_path / "character_error_report_details.json").read_text() == json.dumps(errors, ensure_ascii=False, indent=2)
    assert not [p for p in tmp_path.iterdir() if p.suffix == ".part"]
    empty = g.limit(0).drop("run_id")
    assert metrics.match_counts(empty, empty, matching.match_records(empty, empty)).first().overall_f1 == 0.0
    assert len(reports.write_reports(reports.evaluate(empty, empty), str(tmp_path / "none"))) == 2


def test_confusion_order(spark):
    rows = [(0, 0, "f", "ab", "xb"), (1, 0, "f", "cb", "yb"), (2, 0, "f", "cb", "yb"), (3, 0, "f", "ab", "xb"), (4, 0, "f", "a", "")]
    df = spark.createDataFrame([(*r, r[3], r[4]) for r in rows], "pair_seq long, field_no int, field string, gt string, ext string, gold_raw string, ext_raw string")
    edits = metrics.edit_rows(df)
    got = [(r.op, r.gt, r.ext, r.n, r["rank"]) for r in metrics.confusions(edits).orderBy("op", "rank").collect()]
    assert got == [("deletion", "a", "", 1, 1), ("substitution", "a", "x", 2, 1), ("substitution", "c", "y", 2, 2)]
    ex = {(r.op, r.gt): [tuple(p) for p in r.examples] for r in metrics.confusion_examples(edits).collect()}
    assert ex["substitution", "a"] == [("ab", "xb"), ("ab", "xb")]
    assert all(len(r.examples) == 1 for r in metrics.confusion_examples(edits, most=1).collect())


def test_segmentation(spark):
    rng = np.random.default_rng(0)
    rows, y = [], 0.0
    for i in range(40):
        y += 30 + (40 if i in (7, 20) else float(rng.integers(0, 3)))
        for side, x in (("L", 10.0), ("R", 400.0)):
            rows.append((0, 2 * i + (side == "R"), (x, y, x + 100, y + 25), f"{side}{i}", 0.9))
    df = spark.createDataFrame(rows, "page int, seq int, bbox struct<x_min: double, y_min: double, x_max: double, y_max: double>, text string, confidence double")
    got = segment.segment_entries(segment.split_columns(df, 600.0), ["page"]).orderBy("column", "entry_no").collect()
    assert [(r.entry_id, r.n_lines) for r in got] == [(f"{c}{k:03d}", n) for c in "LR" for k, n in enumerate((7, 13, 20))]
    assert [x.text for x in got[0].lines] == [f"L{i}" for i in range(7)]


def test_layout(spark):
    rows = [("p", 100, 100, [("text", "a", [1.0, 2.0, 3.9, 4.0], 0, None, 0), ("text", "", [1.0, 2.0, 3.0, 4.0], 1, 1, 0), ("title", "t", [1.0, 2.0, 3.0, 4.0], 2, 3, 0), ("text", "b", [1.0], 3, 1, 0)])]
    df = spark.createDataFrame(rows, "input_path string, width int, height int, parsing_res_list array<struct<block_label: string, block_content: string, block_bbox: array<double>, block_id: int, block_order: int, group_id: int>>")
    assert [(r.name, r.box) for r in layout.block_files(layout.layout_blocks(df)).collect()] == [("block_000_text", [1, 2, 3, 4])]
    assert [(r.colour, r.caption) for r in layout.annotations(layout.layout_blocks(df, False)).orderBy("seq").collect()] == [("green", "text"), ("green", "text [1]"), ("black", "title [3]")]
    assert layout.block_counts(df).first().n_text_blocks == 2


def test_experiments(spark):
    totals = spark.createDataFrame([("a", 0.5, 0.25)], "run_id string, cer double, wer double")
    variants = spark.createDataFrame([("b", "B", 2, True), ("a", "A", 1, True), ("c", "C", 3, False)], "run_id string, label string, seq int, has_image boolean")
    assert [(r.run_id, r.cer) for r in experiments.compare_runs(variants, totals).collect()] == [("a", "0.5000 (50.00%)"), ("b", "N/A"), ("c", "N/A")]
    counts = spark.createDataFrame([("a", 0.75)], "run_id string, overall_f1 double")
    assert [(r.run_id, r.overall_f1) for r in experiments.ablation_table(variants, totals, counts).collect()] == [("a", "0.750"), ("b", "ERROR")]


def test_images(spark):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (37, 53), dtype=np.uint8), rng.integers(0, 256, (20, 31, 3), dtype=np.uint8)
    for im in (grey, colour):
        assert (images.decode(images.encode(im)) == im).all()
    assert (images.decode(b"P5 53 37 255\n" + grey.tobytes()) == grey).all()
    page = np.full((200, 300), 255, np.uint8)
    page[20:180:20, 30:270] = 0
    page[21:181:20, 30:270] = 0
    turned = images.rotate(page, 3.0)
    assert abs(images.skew_angle(turned)) > 2 and abs(images.skew_angle(images.deskew(turned))) < 1
    flat = np.full((64, 64), 100, np.uint8)
    assert (images.denoise(flat) == flat).all() and (images.sharpen(flat) == flat).all()
    df = spark.createDataFrame([("a.png", bytearray(images.encode(page))), ("bad.png", bytearray(b"no image"))], "name string, content binary")
    made = images.preprocessed(df, images.variants()).collect()
    assert len(made) == 12 and sum(r.error is not None for r in made) == 6
    boxes = spark.createDataFrame([("a.png", "x", [30, 20, 40, 22])], "page string, name string, box array<int>")
    cut = images.cropped(df.withColumnRenamed("name", "page"), boxes).first()
    assert images.decode(bytes(cut.content)).shape == (2, 10) and images.draw_boxes(page, [[1, 2, 30, 40]]).shape == (200, 300, 3)
