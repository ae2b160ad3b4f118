"""Commands: evaluate, extract, ocr, layout-ocr, segment, layout, annotate, to-tsv, preprocess, compare."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import experiments, images, layout, segment
from .operators.storage import stored
from .plans import reports
from .session import local_session, shipped
from .sources import extract, readers, recognise, writers


def _read(spark, path: str):
    """Records of a file with one number per row: JSON or tab-separated."""
    df = readers.read_records_json(spark, path) if path.endswith(".json") else readers.read_tsv(spark, path)
    return df.drop("path")


def _folder(path: str) -> str:
    """Where a file is."""
    return path.rpartition("/")[0] or ("/" if path.startswith("/") else ".")


def _evaluate(spark, a) -> None:
    e = reports.evaluate(_read(spark, a.gold), _read(spark, a.extracted), partial=a.threshold)
    for path in reports.write_reports(e, a.output or _folder(a.extracted), not a.no_char_analysis):
        print(path)
    print(reports.evaluation_text(e))


def _extract(spark, a) -> None:
    mode = extract.single_mode(image=a.image, crops=a.crops_dir, layout=a.layout_json)
    model, steps = extract.model(a.model), extract.PREPROCESS[a.preprocess]
    found = {
        "image": lambda: extract.extract_image(spark, a.image, model, a.document, a.page, steps),
        "crops": lambda: extract.extract_crops(spark, a.crops_dir, model, a.page),  # crops are taken as they are
        "layout": lambda: extract.extract_layout(spark, a.layout_json, model, a.page, a.layout_image, steps),
    }[mode]()
    entries = extract.to_entries(found)
    writers.write_tsv(entries, a.output, a.append)
    if a.json:
        writers.write_json_array(writers.to_json_names(entries), a.output.rsplit(".", 1)[0] + ".json")
    for r in writers.preview(entries).collect():
        print(r.line)


def _segment(spark, a) -> None:
    lines = segment.split_columns(segment.ocr_lines(readers.read_engine_results(spark, a.input), ["path"], a.confidence), a.width)
    found = segment.crop_boxes(segment.segment_entries(lines, ["path"], a.gap_multiplier), a.width, a.height, a.padding)
    writers.write_json_array(found.orderBy("path", "column", "entry_no"), a.output)


def _failed(found, key: str, output: str) -> int:
    """Failures beside the output; the exit code."""
    failed = stored(recognise.failures(found, key), "failures")
    writers.write_json_array(failed.orderBy("item"), f"{output}/failures.json")
    for r in failed.orderBy("item").limit(20).collect():
        print(f"{r.item}: {r.error}", file=sys.stderr)
    return 0 if failed.isEmpty() else 1


def _engine(a):
    options = dict(x.partition("=")[::2] for x in a.option or ())
    return recognise.engine(a.engine, options), f"{a.engine} {sorted(options.items())}"


def _ocr(spark, a) -> int:
    """Pages to lines, columns and entries: entries.json and a crop of each entry. Finished recognition is used again."""
    images = recognise.preprocessed_pages(readers.read_images(spark, a.image), extract.PREPROCESS[a.preprocess])
    engine, settings = _engine(a)
    found = recognise.reused(images, f"{a.output}/lines", f"{settings} {a.preprocess}", lambda todo: recognise.recognised_lines(todo, engine))
    entries = stored(recognise.page_entries(found, a.confidence, a.gap_multiplier, a.padding), "entries")
    writers.write_json_array(entries.orderBy("path", "place"), f"{a.output}/entries.json")
    writers.write_files(recognise.entry_crops(entries, images), f"{a.output}/entry_crops")
    return _failed(found, "path", a.output)


def _layout_ocr(spark, a) -> int:
    """Pages to layouts: layouts.json, and a crop and a text of each text block. Finished recognition is used again."""
    images = readers.read_images(spark, a.image).select("path", "content")
    engine, settings = _engine(a)
    all_ = recognise.reused(images, f"{a.output}/layouts", settings, lambda todo: recognise.recognised_layouts(todo, engine), "input_path")
    found = all_.where("error IS NULL").drop("error")
    writers.write_json_array(found.orderBy("input_path"), f"{a.output}/layouts.json")
    writers.write_files(recognise.block_crops(found, images), f"{a.output}/crops")
    return _failed(all_, "input_path", a.output)


def _layout(spark, a) -> None:
    writers.write_json_array(layout.annotations(layout.layout_blocks(readers.read_layouts(spark, a.input), text_only=False)), a.output)


def _annotate(spark, a) -> None:
    """Blocks drawn on their page's image, one file for each layout."""
    made = layout.annotated(readers.read_layouts(spark, a.json), readers.read_images(spark, a.image), a.thickness)
    writers.write_files(made, a.output)


def _to_tsv(spark, a) -> None:
    writers.write_tsv(_read(spark, a.json), a.output or a.json.rsplit(".", 1)[0] + ".tsv")


def _preprocess(spark, a) -> None:
    plans = images.variants() if a.variants else [("all_steps", a.steps.split(","))]
    made = images.preprocessed(readers.read_images(spark, a.input), plans)
    writers.write_files(made.where("error IS NULL").select(F.concat_ws("_", "variant", "name").alias("name"), "content"), a.output)


def _compare(spark, a) -> None:
    """Runs given as label=extracted file, against one gold file: a table of error rates."""
    gold, sides, golds, rows = _read(spark, a.gold), None, None, []
    for k, item in enumerate(a.runs):
        label, _, path = item.partition("=")
        rows.append((label, label, k))
        run = _read(spark, path).withColumn("run_id", F.lit(label))
        own = gold.withColumn("run_id", F.lit(label))
        sides, golds = (run, own) if sides is None else (sides.unionByName(run), golds.unionByName(own))
    e = reports.evaluate(golds, sides, ["run_id"])
    for r in experiments.compare_runs(spark.createDataFrame(rows, "run_id string, label string, seq int"), e.totals).collect():
        print(f"{r.label:<40} {r.cer:<20} {r.wer}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("scriptorium")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, more in options:
            c.add_argument(*flags, **more)

    out = (("-o", "--output"), {"required": True})
    command("evaluate", _evaluate, (("-e", "--extracted"), {"required": True}), (("-g", "--gold"), {"required": True}), (("-o", "--output"), {}), (("-t", "--threshold"), {"type": float, "default": 0.85}), (("--no-char-analysis",), {"action": "store_true"}))
    command("extract", _extract, (("-i", "--image"), {}), (("--crops-dir",), {}), (("--layout-json",), {}), out, (("-d", "--document"), {}), (("-m", "--model"), {"default": "pattern"}), (("--preprocess",), {"choices": list(extract.PREPROCESS), "default": "none"}), (("--layout-image",), {}), (("-p", "--page"), {"type": int, "default": 1}), (("-a", "--append"), {"action": "store_true"}), (("--json",), {"action": "store_true"}))
    command("ocr", _ocr, (("-i", "--image"), {"required": True}), out, (("-e", "--engine"), {"required": True}), (("--option",), {"action": "append", "metavar": "KEY=VALUE", "help": "for the engine, as often as needed"}), (("--preprocess",), {"choices": list(extract.PREPROCESS), "default": "none"}), (("--padding",), {"type": int, "default": 20}), (("--confidence",), {"type": float, "default": 0.5}), (("--gap-multiplier",), {"type": float, "default": 2.0}))
    command("layout-ocr", _layout_ocr, (("-i", "--image"), {"required": True}), out, (("-e", "--engine"), {"required": True}), (("--option",), {"action": "append", "metavar": "KEY=VALUE", "help": "for the engine, as often as needed"}))
    command("segment", _segment, (("-i", "--input"), {"required": True}), out, (("--width",), {"type": float, "required": True}), (("--height",), {"type": float, "default": 1e9}), (("--padding",), {"type": int, "default": 20}), (("--confidence",), {"type": float, "default": 0.5}), (("--gap-multiplier",), {"type": float, "default": 2.0}))
    command("layout", _layout, (("-i", "--input"), {"required": True}), out)
    command("annotate", _annotate, (("-i", "--image"), {"required": True}), (("-j", "--json"), {"required": True}), out, (("--thickness",), {"type": int, "default": 3}))
    command("to-tsv", _to_tsv, (("json",), {}), (("-o", "--output"), {}))
    command("preprocess", _preprocess, (("-i", "--input"), {"required": True}), out, (("--steps",), {"default": ",".join(images.STEPS)}), (("--variants",), {"action": "store_true"}))
    command("compare", _compare, (("-g", "--gold"), {"required": True}), (("runs",), {"nargs": "+"}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(shipped(local_session()), args) or 0


if __name__ == "__main__":
    sys.exit(main())
