from __future__ import annotations

import json
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from scriptorium import cli
from scriptorium.operators import images
from scriptorium.operators.numbering import numbered_in_order
from scriptorium.schemas import TSV_FIELDS
from scriptorium.sources import extract, readers, recognise, writers
from scriptorium.streaming import entries


def test_tsv_round_trip(spark, tmp_path):
    rows = [(0, "a\tb", "word", "", 'say "x"', "", "line\nbreak"), (1, "ч", "phrase", "n", "t", "l", "g")]
    df = spark.createDataFrame(rows, "seq long, " + ", ".join(f"{c} string" for c in TSV_FIELDS))
    path = str(tmp_path / "x.tsv")
    writers.write_tsv(df, path)
    writers.write_tsv(df.where("seq = 1"), path, append=True)
    got = [tuple(r) for r in readers.read_tsv(spark, path).orderBy("seq").select(*TSV_FIELDS).collect()]
    assert got == [r[1:] for r in [*rows, rows[1]]]
    assert open(path, newline="").read().startswith("\t".join(TSV_FIELDS) + "\r\n")


def test_short_rows(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("Headword_Phrase\tPOS\nx\ny\tn\n")
    got = readers.read_tsv(spark, str(tmp_path / "s.tsv")).orderBy("seq").collect()
    assert [(r.Headword_Phrase, r.POS, r.Entry_Type) for r in got] == [("x", "", ""), ("y", "n", "")]


def test_json_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"headword_phrase": "a", "pos": None}, {"headword_phrase": "b", "other": 1}], indent=1))
    df = readers.read_records_json(spark, str(tmp_path / "r.json"))
    assert [(r.seq, r.Headword_Phrase, r.POS, r.Entry_Type) for r in df.orderBy("seq").collect()] == [(0, "a", "", ""), (1, "b", "", "")]
    writers.write_json_array(writers.to_json_names(df.orderBy("seq")), str(tmp_path / "o.json"))
    assert [x["headword_phrase"] for x in json.loads((tmp_path / "o.json").read_text())] == ["a", "b"]


def test_docx(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    assert readers.read_texts(spark, str(tmp_path / "d.docx")).first().text == "one\ntwo\tx"


def test_crops_and_extraction(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"block_00{k}_text.png").write_bytes(images.encode(np.zeros((2, 2), np.uint8)))
    (tmp_path / "block_001_text.md").write_text("dog (n.) hound")
    (tmp_path / "block_001_text.txt").write_text("not this")
    (tmp_path / "block_002_text.txt").write_text("cat (n.) feline\nrun (v.) go")
    found = extract.to_entries(extract.extract_crops(spark, str(tmp_path), extract.Pattern()))
    assert [(r.Headword_Phrase, r.POS, r.Translation_RU, r.Entry_Type) for r in found.orderBy("seq").collect()] == [("dog", "n.", "hound", "word"), ("cat", "n.", "feline", "word"), ("run", "v.", "go", "word")]
    with pytest.raises(FileNotFoundError):
        readers.read_crops(spark, str(tmp_path / "block_001_text.md"))


def test_errors_stay_with_their_item(spark):
    df = spark.createDataFrame([("a", None, "x", 1), ("b", None, "y", 1)], "item string, content binary, text string, page int")
    got = extract.answers(df, extract.Replay({"x": '[{"headword_phrase": "h"}]'}))
    assert extract.records(got).count() == 1 and extract.failures(got).first().item == "b"
    with pytest.raises(ValueError, match="give one"):
        extract.single_mode(image=None, crops="x", layout="y")


def test_layout_extraction(spark, tmp_path):
    block = {"block_label": "text", "block_content": "dog (n.) hound", "block_bbox": [0, 0, 5, 5], "block_id": 0, "block_order": 1, "group_id": 0}
    (tmp_path / "l.json").write_text(json.dumps({"input_path": "p.png", "width": 9, "height": 9, "parsing_res_list": [block, block | {"block_label": "image"}]}, indent=1))
    (tmp_path / "p.png").write_bytes(images.encode(np.arange(81, dtype=np.uint8).reshape(9, 9)))
    assert extract.extract_layout(spark, str(tmp_path / "l.json"), extract.Pattern(), image=str(tmp_path / "p.png")).count() == 1
    (item,) = extract.layout_items(spark, str(tmp_path / "l.json"), str(tmp_path / "p.png")).collect()
    assert images.decode(item.content).tolist() == np.arange(81).reshape(9, 9)[:5, :5].tolist() and item.text == "dog (n.) hound" and item.failed is None
    (tmp_path / "l2.json").write_text(json.dumps({"input_path": str(tmp_path / "p.png"), "width": 9, "height": 9, "parsing_res_list": [block, block | {"block_content": ""}, block | {"block_bbox": [1, 2]}]}))
    (item,) = extract.layout_items(spark, str(tmp_path / "l2.json"), steps=("contrast",)).collect()  # the image is where the layout says
    assert images.decode(item.content).shape == (5, 5)
    (tmp_path / "other.png").write_bytes(b"no image")
    lost = extract.layout_items(spark, str(tmp_path / "l.json"), str(tmp_path / "other.png"))
    assert "ValueError" in extract.failures(extract.answers(lost, extract.Pattern())).first().error
    cli.main(["annotate", "-i", str(tmp_path / "p.png"), "-j", str(tmp_path / "l.json"), "-o", str(tmp_path / "drawn"), "--thickness", "1"])
    drawn = images.decode((tmp_path / "drawn" / "p_annotated.png").read_bytes())
    assert drawn.shape == (9, 9, 3) and drawn[4, 2].tolist() == [0, 0, 255]
    cli.main(["layout", "-i", str(tmp_path / "l.json"), "-o", str(tmp_path / "a.json")])
    assert [x["colour"] for x in json.loads((tmp_path / "a.json").read_text())] == ["green", "orange"]


def test_png_kinds():
    """Palettes and other depths, written by hand."""
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    png = lambda w, h, bits, colour, raw, *more: images._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    palette = chunk(b"PLTE", bytes([1, 2, 3, 40, 50, 60, 7, 8, 9, 0, 0, 255]))
    assert images.decode(png(5, 2, 2, 3, bytes([0, 0b00011011, 0b01000000, 2, 0, 0]), palette)).tolist() == [[[1, 2, 3], [40, 50, 60], [7, 8, 9], [0, 0, 255], [40, 50, 60]]] * 2
    assert images.decode(png(3, 1, 1, 0, bytes([0, 0b10100000]))).tolist() == [[255, 0, 255]]
    assert images.decode(png(2, 1, 4, 0, bytes([0, 0x5F]))).tolist() == [[85, 255]]
    assert images.decode(png(2, 2, 16, 0, bytes([1, 10, 99, 5, 1, 2, 1, 0, 1, 0]))).tolist() == [[10, 15], [11, 16]]
    assert images.decode(png(1, 1, 16, 2, bytes([0, 9, 0, 8, 0, 7, 0]))).tolist() == [[[9, 8, 7]]]
    with pytest.raises(ValueError, match="interlacing"):
        images.decode(images.encode(np.zeros((2, 2), np.uint8))[:28] + b"\x01" + images.encode(np.zeros((2, 2), np.uint8))[29:])


def test_extract_command(spark, tmp_path):
    (tmp_path / "page.png").write_bytes(images.encode(np.full((4, 4), 90, np.uint8)))
    (tmp_path / "page.txt").write_text("dog (n.) hound")
    (tmp_path / "answers.json").write_text(json.dumps({"dog (n.) hound": '[{"headword_phrase": "stored"}]'}))
    common = ["extract", "-i", str(tmp_path / "page.png"), "-d", str(tmp_path / "page.txt")]
    for more, want in (([], "dog"), (["-m", f"replay:{tmp_path}/answers.json"], "stored"), (["-m", "tests.test_sources:Bright", "--preprocess", "contrast"], "4x4 grey")):
        cli.main([*common, "-o", str(tmp_path / "out.tsv"), *more])
        assert readers.read_tsv(spark, str(tmp_path / "out.tsv")).first().Headword_Phrase == want
    with pytest.raises(ValueError, match="unknown model"):
        extract.model("nothing")
    assert [cli._folder(x) for x in ("e.tsv", "/e.tsv", "a/e.tsv", "s3://b/a/e.tsv")] == [".", "/", "a", "s3://b/a"]


def test_recognition_commands(spark, tmp_path):
    page = np.arange(3_000, dtype=np.uint32).reshape(50, 60).astype(np.uint8)
    (tmp_path / "p.png").write_bytes(images.encode(page))
    (tmp_path / "q.png").write_bytes(b"broken")
    box = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    lines = [(box(35, 2, 55, 6), "right", 0.9), (box(2, 2, 20, 6), "one", 0.9), (box(2, 8, 20, 12), "two", 0.9), (box(2, 30, 20, 34), "three", 0.9), (box(2, 14, 20, 18), "weak", 0.2)]
    (tmp_path / "lines.json").write_text(json.dumps({"p.png": lines}))
    run = ["ocr", "-i", f"{tmp_path}/*.png", "-o", f"{tmp_path}/out", "--padding", "1", "-e"]
    cli.main([*run, f"stored:{tmp_path}/lines.json"])
    entries = json.loads((tmp_path / "out" / "entries.json").read_text())
    assert [e["entry_id"] for e in entries][-1] == "R000" and [e["place"] for e in entries] == list(range(len(entries)))
    assert [x["text"] for e in entries for x in e["lines"]] == ["one", "two", "three", "right"]
    got = images.decode((tmp_path / "out" / "entry_crops" / "p_R000.png").read_bytes())
    assert got.tolist() == page[1:7, 34:56].tolist()
    (bad,) = json.loads((tmp_path / "out" / "failures.json").read_text())
    assert bad["item"].rsplit("/", 1)[1] == "q.png" and "ValueError" in bad["error"]
    (tmp_path / "lines.json").write_text("{}")
    (tmp_path / "q.png").unlink()
    assert cli.main([*run, f"stored:{tmp_path}/lines.json"]) == 0  # what is finished isn't asked for again
    assert len(json.loads((tmp_path / "out" / "entries.json").read_text())) == len(entries)
    assert cli.main([*run, "tests.test_sources:NoEngine"]) == 1  # another engine is
    assert [x["item"].rsplit("/", 1)[1] for x in json.loads((tmp_path / "out" / "failures.json").read_text())] == ["p.png"]
    block = {"block_label": "text", "block_content": "words", "block_bbox": [1, 2, 9, 8], "block_id": 4, "block_order": 1, "group_id": 0}
    (tmp_path / "layouts.json").write_text(json.dumps({"p.png": {"width": 60, "height": 50, "parsing_res_list": [block, block | {"block_label": "image", "block_id": 5}]}}))
    cli.main(["layout-ocr", "-i", f"{tmp_path}/p.png", "-o", f"{tmp_path}/vl", "-e", f"stored:{tmp_path}/layouts.json"])
    assert sorted(x.name for x in (tmp_path / "vl" / "crops").iterdir()) == ["block_004_text.md", "block_004_text.png"]
    assert images.decode((tmp_path / "vl" / "crops" / "block_004_text.png").read_bytes()).shape == (6, 8) and (tmp_path / "vl" / "crops" / "block_004_text.md").read_text() == "words"
    assert extract.extract_crops(spark, f"{tmp_path}/vl/crops", extract.Pattern()).first().headword_phrase == "words"
    assert len(json.loads((tmp_path / "vl" / "layouts.json").read_text())[0]["parsing_res_list"]) == 2
    with pytest.raises(ValueError, match="unknown engine"):
        recognise.engine("x")


class NoEngine:
    def lines(self, image, name):
        raise AssertionError("asked again")


class Bright:
    """An extractor that looks at the image."""

    def extract(self, image, text, page):
        x = images.decode(image)
        return json.dumps({"headword_phrase": f"{x.shape[0]}x{x.shape[1]} {'grey' if x.ndim == 2 else 'colour'}"})


def test_labels():
    blank = np.zeros((20, 40, 3), np.uint8)
    got = images.write_label(blank, "[1]", 3, 18, (9, 9, 9), 1)
    assert got[11:18, 3:16].any() and not got[:11].any() and not got[18:].any() and (got == 255).any()
    assert images.write_label(blank, "text [12]", 35, 4, (9, 9, 9)).shape == blank.shape


def test_numbers_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "page string, x double").repartition(7)
    got = numbered_in_order(df, ["x"], ["page"], "n").collect()
    assert sorted((r.page, r.n, r.x) for r in got) == [(p, k, x) for p in "abc" for k, x in enumerate(sorted(x for q, x in rows if q == p))]
    assert numbered_in_order(df, ["page", "x"], [], "n").agg({"n": "max"}).first()[0] == 499


def test_evaluate_command(spark, tmp_path, capsys):
    (tmp_path / "g.tsv").write_text("\t".join(TSV_FIELDS) + "\nalpha\tword\tn\tfirst\t\t\nbeta\tword\tn\tsecond\t\t\n")
    (tmp_path / "e.tsv").write_text("\t".join(TSV_FIELDS) + "\nalpha\tword\tn\tfirst\t\t\ngamma\tword\tn\tthird\t\t\n")
    cli.main(["evaluate", "-e", str(tmp_path / "e.tsv"), "-g", str(tmp_path / "g.tsv")])
    out = capsys.readouterr().out
    assert "Exact matches: 1" in out and "Missing entries: 1" in out and "Extra entries: 1" in out and "Overall F1 Score: 0.500" in out
    cli.main(["compare", "-g", str(tmp_path / "g.tsv"), f"one={tmp_path}/e.tsv", f"two={tmp_path}/g.tsv"])
    assert capsys.readouterr().out.count("0.0000 (0.00%)") == 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"run_id": "r", "at": f"2024-01-01T00:{m:02d}:00", "gold": "abcd", "extracted": "abxd"} for m in (1, 5, 12)] + [{"run_id": "r", "at": "2024-01-02T00:00:00", "gold": "a", "extracted": "a"}]
    for k, r in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(r))
    errors = entries.windowed_errors(entries.pair_stream(spark, str(tmp_path / "in")))
    entries.to_parquet(errors, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert [(r.chars, r.errors, r.cer) for r in got] == [(8, 2, 0.25), (4, 1, 0.25)]
