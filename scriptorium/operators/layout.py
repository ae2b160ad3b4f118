"""Blocks of a page's layout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid_box, whole_box
from ..functions.text import block_caption, block_id, label_colour, name, stem
from . import images as kernels

# The colours (red, green, blue) that blocks are drawn in, by label, and that of all others.
DRAWN = {"paragraph_title": (255, 0, 0), "text": (0, 255, 0), "image": (0, 0, 255), "table": (0, 255, 255), "figure": (255, 0, 255), "formula": (255, 255, 0)}
DRAWN_OTHER = (0, 128, 255)


def layout_blocks(layouts: DataFrame, text_only: bool = True) -> DataFrame:
    """A row per block with a valid box; text_only: of those labelled text that have content."""
    rows = layouts.select("input_path", "width", "height", F.posexplode("parsing_res_list").alias("seq", "b")).select("input_path", "width", "height", "seq", "b.*")
    rows = rows.where(valid_box("block_bbox"))
    return rows.where((F.col("block_label") == "text") & (F.coalesce(F.col("block_content"), F.lit("")) != "")) if text_only else rows


def block_files(blocks: DataFrame) -> DataFrame:
    """name, text and whole pixel box of each block's crop."""
    return blocks.select("input_path", F.concat(block_id("block_id"), F.lit("_text")).alias("name"), "block_content", whole_box("block_bbox").alias("box"))


def annotations(blocks: DataFrame) -> DataFrame:
    """What is drawn for each block: whole pixel box, colour and caption."""
    return blocks.select("input_path", "seq", whole_box("block_bbox").alias("box"), label_colour("block_label").alias("colour"), block_caption("block_label", "block_order").alias("caption"))


def annotated(layouts: DataFrame, images: DataFrame, thickness: int = 3) -> DataFrame:
    """Blocks with a valid box drawn on the image of their page (found by its file name), with label and order: name, content (PNG).

    A page that has no image gives no row."""
    block = F.struct(F.col("seq"), whole_box("block_bbox").alias("box"), F.coalesce("block_label", F.lit("unknown")).alias("label"), block_caption(F.coalesce("block_label", F.lit("unknown")), "block_order").alias("caption"))
    pages = layout_blocks(layouts, text_only=False).groupBy("input_path").agg(F.array_sort(F.collect_list(block)).alias("blocks"))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for content, blocks in batches:
            out = []
            for c, own in zip(content.to_pylist(), blocks.to_pylist(), strict=True):
                image = kernels.draw_boxes(kernels.decode(c), [], thickness=thickness)
                for b in own:
                    colour = DRAWN.get(b["label"], DRAWN_OTHER)
                    image = kernels.draw_boxes(image, [b["box"]], colour, thickness)
                    image = kernels.write_label(image, b["caption"], b["box"][0], b["box"][1], colour)
                out.append(kernels.encode(image))
            yield pa.array(out, pa.binary())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    found = pages.withColumn("_name", name("input_path")).join(images.select(F.col("name").alias("_name"), "content"), "_name")
    return found.select(F.concat(stem("input_path"), F.lit("_annotated.png")).alias("name"), F.arrow_udf(run, "binary")("content", "blocks").alias("content"))


def block_counts(layouts: DataFrame) -> DataFrame:
    rows = layouts.select("input_path", F.explode_outer("parsing_res_list").alias("b"))
    return rows.groupBy("input_path").agg(F.count("b").alias("n_blocks"), F.count_if((F.col("b.block_label") == "text") & (F.size("b.block_bbox") == 4)).alias("n_text_blocks"))


def with_sidecar(images: DataFrame, markdown: DataFrame, plain: DataFrame) -> DataFrame:
    """Images (stem, ...) with the text of equal stem: markdown first, else plain; images without either go."""
    joined = images.join(markdown.select("stem", F.col("text").alias("_md")), "stem", "left").join(plain.select("stem", F.col("text").alias("_txt")), "stem", "left")
    return joined.withColumn("text", F.coalesce("_md", "_txt")).drop("_md", "_txt").where("text IS NOT NULL")
