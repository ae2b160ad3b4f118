"""Readers: tab-separated records, record and layout JSON, texts, DOCX, images, folders with sidecar texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base64_text, default_if_empty, name, parse_records, stem
from ..operators.layout import with_sidecar
from ..schemas import ENGINE_RESULT, FIELDS, JSON_RECORD, LAYOUT, TSV_FIELDS


def numbered(df: DataFrame, by: str = "path") -> DataFrame:
    """seq: the row's place within its file. Files of records are whole-file reads, so a file's rows share a task."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("_at")) - 1).drop("_at")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Records of tab-separated files with a header: path, seq, six text columns ('' for missing and empty cells).

    Columns are found by the header's names; line breaks in quotes are part of a cell."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, inferSchema=False, enforceSchema=False).withColumn("path", F.input_file_name())
    have = {c.strip("﻿"): c for c in raw.columns}
    cells = [F.coalesce(F.col(f"`{have[c]}`"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in TSV_FIELDS]
    return numbered(raw.select("path", *cells))


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files, each one array: path, seq, the six fields by their names in tab-separated files."""
    raw = spark.read.schema(JSON_RECORD).json(path, multiLine=True).withColumn("path", F.input_file_name())
    return numbered(raw.select("path", *(F.coalesce(k, F.lit("")).alias(v) for k, v in FIELDS.items())))


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).json(path, multiLine=True).withColumn("path", F.input_file_name())


def read_engine_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENGINE_RESULT).json(path, multiLine=True).withColumn("path", F.input_file_name())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files; .docx files as their paragraphs that aren't blank."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([_docx(x) if x[:2] == b"PK" else x.decode("utf-8") for x in b.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return files.select("path", stem("path").alias("stem"), F.arrow_udf(run, "string")("content").alias("text"))


def _docx(content: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    pieces = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    paragraphs = ("".join(pieces[e.tag](e) for e in p.iter() if e.tag in pieces) for p in root.iter(f"{w}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name, stem, content of image files."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", name("path").alias("name"), stem("path").alias("stem"), "content")


def read_crops(spark: SparkSession, folder: str) -> DataFrame:
    """block_*_text.png files with their .md or else .txt texts, sorted by path; an error if there are none."""
    images = read_images(spark, folder, "block_*_text.png")
    if images.isEmpty():
        raise FileNotFoundError(f"no block images in {folder}")
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "block_*_text.{md,txt}").load(folder)
    texts = texts.select(stem("path").alias("stem"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind"), F.decode("content", "UTF-8").alias("text"))
    return with_sidecar(images, texts.where("kind = 'md'"), texts.where("kind = 'txt'")).orderBy("path")


def image_base64(images: DataFrame) -> DataFrame:
    return images.withColumn("base64", base64_text("content"))


def records_of_answers(answers: DataFrame, column: str = "answer", strict: bool = True) -> DataFrame:
    """Rows of a model's answers: fence stripped, JSON parsed, defaults set, records without headword dropped.

    strict: text that is no JSON raises an error; else it gives no rows. The columns beside are kept."""
    rest = [c for c in answers.columns if c != column]
    parsed = parse_records(column, JSON_RECORD)
    if strict:
        parsed = F.coalesce(parsed, F.raise_error(F.concat(F.lit("no JSON records: "), F.substring(F.coalesce(F.col(column), F.lit("null")), 1, 200))))
    rows = answers.select(*rest, F.posexplode(parsed).alias("seq", "r"))
    fields = [default_if_empty(f"r.{k}", "word" if k == "entry_type" else "").alias(k) for k in FIELDS]
    return rows.select(*rest, "seq", *fields).where("headword_phrase <> ''")
