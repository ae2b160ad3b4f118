"""Recognition by pluggable engines: images to lines of text, or to layouts, with finished output used again.

Engines are outside this library. One that finds lines has `lines`, one that finds layouts has `layout`; Stored gives the
results of earlier runs by file name, so that pipelines run and can be tested offline."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name as file_name
from ..operators import images as kernels
from ..operators import segment
from ..operators.layout import block_files, layout_blocks
from ..schemas import ENGINE_RESULT, LAYOUT
from . import incremental


class LineEngine(Protocol):
    def lines(self, image: bytes, name: str) -> list[tuple[list[list[float]], str, float]]:
        """Polygon, text and score of each line."""


class LayoutEngine(Protocol):
    def layout(self, image: bytes, name: str) -> dict:
        """Width, height and parsing_res_list, as in layout files."""


@dataclass
class Stored:
    """Results of earlier runs by the image's file name."""

    results: dict = field(default_factory=dict)

    def lines(self, image: bytes, name: str) -> list:
        return self.results[name]

    def layout(self, image: bytes, name: str) -> dict:
        return self.results[name]


def engine(name: str, options: dict[str, str] | None = None):
    """stored:FILE, a JSON object of results by file name, or MODULE:ATTRIBUTE, which is called with the options if it is no engine itself."""
    import importlib

    kind, _, rest = name.partition(":")
    if not rest:
        raise ValueError(f"unknown engine {name}: give stored:FILE or MODULE:ATTRIBUTE")
    if kind == "stored":
        with open(rest, encoding="utf-8") as f:
            return Stored(json.load(f))
    found = getattr(importlib.import_module(kind), rest)
    return found(**options or {}) if isinstance(found, type) or not (hasattr(found, "lines") or hasattr(found, "layout")) else found


def _asked(images: DataFrame, schema: str, ask: Callable[[bytes, str], dict]) -> DataFrame:
    """images (path, content) with what ask gives for each as columns of schema, and error; all null but one side."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for content, name in batches:
            out = []
            for c, n in zip(content.to_pylist(), name.to_pylist(), strict=True):
                try:
                    out.append({"result": json.dumps(ask(c, n), ensure_ascii=False), "error": None})
                except Exception as e:  # one bad image must not end the job
                    out.append({"result": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, pa.struct([("result", pa.string()), ("error", pa.string())]))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    made = images.withColumn("_r", F.arrow_udf(run, "result string, error string")("content", file_name("path")))
    return made.select("path", F.from_json("_r.result", schema).alias("r"), F.col("_r.error").alias("error")).select("path", "r.*", "error")


def recognised_lines(images: DataFrame, engine: LineEngine) -> DataFrame:
    """images: path, content. Parallel arrays of polygons, texts and scores (as engine results have them), width and height, and error."""

    def ask(content: bytes, name: str) -> dict:
        shape = kernels.decode(content).shape
        found = engine.lines(content, name)
        return {"dt_polys": [x[0] for x in found], "rec_texts": [x[1] for x in found], "rec_scores": [x[2] for x in found], "width": shape[1], "height": shape[0]}

    return _asked(images, f"{ENGINE_RESULT}, width int, height int", ask)


def recognised_layouts(images: DataFrame, engine: LayoutEngine) -> DataFrame:
    """images: path, content. Layouts as files have them (input_path is the image's), and error."""
    found = _asked(images, LAYOUT, lambda content, name: engine.layout(content, name))
    return found.withColumn("input_path", F.col("path")).drop("path")


def page_entries(results: DataFrame, least: float = segment.CONFIDENCE, multiplier: float = segment.GAP_MULTIPLIER, padding: int = 20) -> DataFrame:
    """Of recognised lines, the entries of each page in its order, with the boxes of their crops."""
    lines = segment.split_columns(segment.ocr_lines(results.where("error IS NULL"), ["path", "width", "height"], least), "width")
    entries = segment.segment_entries(lines, ["path", "width", "height"], multiplier)
    return segment.in_page_order(segment.crop_boxes(entries, "width", "height", padding), ["path"])


def entry_crops(entries: DataFrame, images: DataFrame) -> DataFrame:
    """name and content (PNG) of each entry's crop, in a folder for its page."""
    box = F.array("crop.x_min", "crop.y_min", "crop.x_max", "crop.y_max")
    boxes = entries.select(F.col("path").alias("page"), F.concat(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("_"), "entry_id", F.lit(".png")).alias("name"), box.alias("box"))
    return kernels.cropped(images.select(F.col("path").alias("page"), "content"), boxes).select("name", "content")


def block_crops(layouts: DataFrame, images: DataFrame) -> DataFrame:
    """name and content of each text block's crop (PNG) and text (Markdown)."""
    blocks = block_files(layout_blocks(layouts)).select(F.col("input_path").alias("page"), "name", "block_content", "box")
    crops = kernels.cropped(images.select(F.col("path").alias("page"), "content"), blocks.select("page", "name", "box"))
    texts = blocks.select(F.concat("name", F.lit(".md")).alias("name"), F.col("block_content").cast("binary").alias("content"))
    return crops.select(F.concat("name", F.lit(".png")).alias("name"), "content").unionByName(texts)


def reused(images: DataFrame, path: str, settings: str, make: Callable[[DataFrame], DataFrame], key: str = "path") -> DataFrame:
    """What make gives for images, kept at path: images that are new or changed, other settings and failed ones are worked on again.

    key: what make calls the column path."""
    named = images.select(F.col("path").alias(key), F.md5("content").alias("fingerprint"))
    given = lambda todo: make(images.join(todo.select(F.col(key).alias("path")), "path", "left_semi"))
    return incremental.kept(named, [key], path, given, settings, failed="error IS NOT NULL")


def preprocessed_pages(images: DataFrame, steps: Sequence[str]) -> DataFrame:
    """images (path, content), preprocessed; those that can't be read stay as they are, and fail where they are recognised."""
    if not steps:
        return images.select("path", "content")
    made = kernels.preprocessed(images.select(F.col("path").alias("name"), "content"), [("steps", steps)])
    made = made.where("error IS NULL").select(F.regexp_replace("name", "^preprocessed_", "").alias("path"), F.col("content").alias("made"))
    return images.select("path", "content").join(made, "path", "left").select("path", F.coalesce("made", "content").alias("content"))


def failures(found: DataFrame, key: str = "path") -> DataFrame:
    """The items that failed, and why."""
    return found.where("error IS NOT NULL").select(F.col(key).alias("item"), "error")
