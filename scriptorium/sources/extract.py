"""Extraction of records by pluggable models: one interface, run over partitions, an error kept with its item.

Models (recognisers, language models) are outside this library. An extractor is any picklable object with `extract`;
Replay gives stored answers and Pattern reads plain lines, so that pipelines run and can be tested offline. `model`
finds one by a name: pattern, given, replay:FILE, or MODULE:ATTRIBUTE of a plug-in."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name as file_name
from ..operators import images as kernels
from ..operators.layout import block_files, layout_blocks
from ..operators.numbering import numbered_in_order
from ..schemas import FIELDS
from .readers import read_crops, read_images, read_layouts, read_texts, records_of_answers


class Extractor(Protocol):
    def extract(self, image: bytes | None, text: str | None, page: int) -> str:
        """The answer as JSON text: an array of records, an object with entries, or one record."""


@dataclass
class Replay:
    """Answers by text."""

    answers: dict[str, str] = field(default_factory=dict)

    def extract(self, image: bytes | None, text: str | None, page: int) -> str:
        return self.answers[text or ""]


@dataclass
class Pattern:
    """Lines such as `headword (pos.) translation`, `headword - translation` or `headword`."""

    line: str = r"^\s*(?P<headword_phrase>[^()]+?)(?:\s*\((?P<pos>[^()]*)\))?(?:(?:\s*[-–—:]\s+|(?<=\))\s*)(?P<translation_ru>[^()]*))?\s*$"

    def extract(self, image: bytes | None, text: str | None, page: int) -> str:
        found = (m.groupdict() for x in (text or "").split("\n") if (m := re.match(self.line, x)))
        return json.dumps([{k: v or "" for k, v in r.items()} for r in found], ensure_ascii=False)


@dataclass
class Given:
    """The text itself is the answer."""

    def extract(self, image: bytes | None, text: str | None, page: int) -> str | None:
        return text


def model(name: str = "pattern") -> Extractor:
    """pattern; given; replay:FILE, a JSON object of answers by text; or MODULE:ATTRIBUTE, which is called if it is no extractor itself."""
    kind, _, rest = name.partition(":")
    if name in ("pattern", "given"):
        return Pattern() if name == "pattern" else Given()
    if not rest:
        raise ValueError(f"unknown model {name}: give pattern, given, replay:FILE or MODULE:ATTRIBUTE")
    if kind == "replay":
        with open(rest, encoding="utf-8") as f:
            return Replay(json.load(f))
    found = getattr(importlib.import_module(kind), rest)
    return found if hasattr(found, "extract") and not isinstance(found, type) else found()


#: Names of preprocessing on the command line, and their steps.
PREPROCESS = {"none": (), **{k: (k,) for k in kernels.STEPS[1:]}, "all": kernels.STEPS}


def prepared(items: DataFrame, steps: Sequence[str] = (), box: str | None = None) -> DataFrame:
    """items with content preprocessed and cropped to the column box (null: not), as PNG; a failure is kept in the column failed.

    Without steps and box content stays as it is."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.struct([("content", pa.binary()), ("failed", pa.string())])
        for content, boxes in batches:
            out = []
            for c, b in zip(content.to_pylist(), boxes.to_pylist(), strict=True):
                try:
                    image = kernels.preprocess(kernels.decode(c), steps) if steps else kernels.decode(c)
                    out.append({"content": kernels.encode(kernels.crop(image, b) if b is not None else image), "failed": None})
                except Exception as e:  # one bad image must not end the job
                    out.append({"content": None, "failed": f"{type(e).__name__}: {e}"})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    if not steps and box is None:
        return items.withColumn("failed", F.lit(None).cast("string"))
    boxes = F.col(box) if box else F.lit(None).cast("array<int>")
    made = F.when(F.col("content").isNotNull(), F.arrow_udf(run, "content binary, failed string")("content", boxes))
    rest = [c for c in items.columns if c != "content"]
    return items.withColumn("_m", made).select(*rest, "_m.content", "_m.failed")


def answers(items: DataFrame, extractor: Extractor) -> DataFrame:
    """items: content (binary, may be null), text, page, and keys. Adds answer and error; one of them is null.

    An item that has failed before (column failed) isn't asked for."""
    before = F.col("failed") if "failed" in items.columns else F.lit(None).cast("string")

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.struct([("answer", pa.string()), ("error", pa.string())])
        for image, text, page, failed in batches:
            out = []
            for i, t, p, e in zip(image.to_pylist(), text.to_pylist(), page.to_pylist(), failed.to_pylist(), strict=True):
                if e is not None:
                    out.append({"answer": None, "error": e})
                    continue
                try:
                    answer = extractor.extract(i, t, p or 0)
                    out.append({"answer": answer, "error": None} if answer is not None else {"answer": None, "error": "no answer"})
                except Exception as e:  # one bad item must not end the job
                    out.append({"answer": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return items.withColumn("_x", F.arrow_udf(run, "answer string, error string")("content", "text", "page", before)).select(*(c for c in items.columns if c != "failed"), "_x.*")


def failures(answered: DataFrame) -> DataFrame:
    return answered.where("error IS NOT NULL").drop("answer", "content")


def records(answered: DataFrame) -> DataFrame:
    """The records of all items that were answered, in order of item and place: with page, item and seq."""
    return records_of_answers(answered.where("error IS NULL").select("item", "page", "answer"), strict=False)


def _items(df: DataFrame, content, text, page: int, *more: str) -> DataFrame:
    return df.select(F.col("item"), content.alias("content"), text.alias("text"), F.lit(page).alias("page"), *more)


def extract_image(spark: SparkSession, image: str, extractor: Extractor, document: str | None = None, page: int = 1, steps: Sequence[str] = ()) -> DataFrame:
    """Images of pages, preprocessed, each with the text of a document if there is one."""
    images = read_images(spark, image).select(F.col("path").alias("item"), "content")
    text = F.lit(None).cast("string")
    if document is not None:
        text = F.lit(read_texts(spark, document).select("text").first().text)  # one document
    return records(answers(prepared(_items(images, F.col("content"), text, page), steps), extractor))


#: Images of layouts that are looked up by the layouts' own paths, at most: beyond, give their folder.
PATHS = 10_000


def layout_items(spark: SparkSession, layout: str, image: str | None = None, page: int = 1, steps: Sequence[str] = ()) -> DataFrame:
    """Each text block of layouts with the crop of its page's image: item, content, text, page, failed.

    image: the image of one layout, or a folder or pattern of images, which are found by the file names in the layouts.
    Without it the paths in the layouts are read."""
    blocks = block_files(layout_blocks(read_layouts(spark, layout))).withColumn("item", F.concat_ws("#", "input_path", "name"))
    if image is None:
        paths = [r.input_path for r in blocks.select("input_path").distinct().limit(PATHS + 1).collect()]
        if len(paths) > PATHS:
            raise ValueError(f"more than {PATHS} pages: give the folder of their images")
        image = paths or None
    if image is None:
        return _items(blocks, F.lit(None).cast("binary"), F.col("block_content"), page, "box").drop("box").withColumn("failed", F.lit(None).cast("string"))
    images = spark.read.format("binaryFile").load(image).select(file_name("path").alias("_name"), "content")
    single = isinstance(image, str) and blocks.select("input_path").distinct().limit(2).count() == 1 and images.limit(2).count() == 1
    own = F.lit(images.first()._name) if single else file_name("input_path")
    joined = blocks.withColumn("_name", own).join(images, "_name", "left")
    made = prepared(_items(joined, F.col("content"), F.col("block_content"), page, "box"), steps, "box").drop("box")
    return made.withColumn("failed", F.coalesce("failed", F.when(F.col("content").isNull(), F.lit("no image"))))


def extract_layout(spark: SparkSession, layout: str, extractor: Extractor, page: int = 1, image: str | None = None, steps: Sequence[str] = ()) -> DataFrame:
    """Each text block of a layout by itself: its crop and its text."""
    return records(answers(layout_items(spark, layout, image, page, steps), extractor))


def extract_crops(spark: SparkSession, folder: str, extractor: Extractor, page: int = 1, steps: Sequence[str] = ()) -> DataFrame:
    """Each block image of a folder with its text."""
    crops = read_crops(spark, folder).withColumnRenamed("path", "item")
    return records(answers(prepared(_items(crops, F.col("content"), F.col("text"), page), steps), extractor))


def single_mode(**paths: str | None) -> str:
    """The one mode that is given: image, crops or layout."""
    given = [k for k, v in paths.items() if v]
    if len(given) != 1:
        raise ValueError(f"give one of {', '.join(paths)}; got {', '.join(given) or 'none'}")
    return given[0]


def to_entries(found: DataFrame) -> DataFrame:
    """Extracted records as entries with the names of tab-separated files, numbered within their page by item and place."""
    placed = numbered_in_order(found, ["item", "seq"], ["page"], "_seq")
    return placed.select("page", F.col("_seq").alias("seq"), *(F.col(k).alias(v) for k, v in FIELDS.items()))
