"""Sinks: distributed writes, and single files where a report or an exchange format asks for one."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FIELDS, TSV_FIELDS
from . import parts


#: Bytes that the driver holds of a file it writes, about.
PIECE = 1 << 20


def write_text(spark: SparkSession, path: str, parts: Iterable[str], append: bool = False) -> bool:
    """To one file in any file system that Spark knows, piece by piece. Whether the file was there before.

    The new file stands beside the old one until it is whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    at, made = hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(at)
    out = fs.create(made, True)
    try:
        if append and there:
            old = fs.open(at)
            hadoop.io.IOUtils.copyBytes(old, out, 1 << 16, False)
            old.close()
        held, size = [], 0
        for part in chain(parts, (None,)):
            if part is not None:
                held.append(part.encode())
                size += len(held[-1])
            if size >= PIECE or part is None and held:
                out.write(bytearray(b"".join(held)))
                held, size = [], 0
    except BaseException:
        out.close()
        fs.delete(made, False)
        raise
    out.close()
    _moved(spark, fs, made, at)
    return there


def _moved(spark: SparkSession, fs, made, at) -> None:
    """made takes the place of at in one step where the file system can; else the old file goes just before."""
    fs_ = spark.sparkContext._jvm.org.apache.hadoop.fs
    kind = getattr(fs_, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    try:
        fs_.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, at, options)
    except Exception:  # a file system without this step
        fs.delete(at, False)
        if not fs.rename(made, at):
            raise


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def tsv_lines(rows: Iterable[dict], header: bool) -> Iterator[str]:
    out = io.StringIO()
    w = csv.DictWriter(out, TSV_FIELDS, delimiter="\t", extrasaction="ignore")
    if header:
        w.writeheader()
    for r in rows:
        w.writerow(r)
        yield out.getvalue()
        out.seek(0)
        out.truncate()
    yield out.getvalue()


def write_tsv(records: DataFrame, path: str, append: bool = False) -> None:
    """One tab-separated file in order of seq, with a header unless appended to a file that is there.

    For exchange; the rows go through the driver a partition at a time, the text piece by piece. write_tsv_parts is the
    distributed form."""
    spark = records.sparkSession
    header = not (append and exists(spark, path))
    rows = (r.asDict() for r in records.orderBy("seq").select(*TSV_FIELDS).toLocalIterator())
    write_text(spark, path, tsv_lines(rows, header), append)


def write_tsv_parts(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    records.select(*TSV_FIELDS).write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"')


def to_json_names(records: DataFrame) -> DataFrame:
    return records.select(*(F.col(v).alias(k) for k, v in FIELDS.items()))


def to_tsv_names(records: DataFrame) -> DataFrame:
    return records.select("seq", *(F.coalesce(k, F.lit("")).alias(v) for k, v in FIELDS.items()))


def json_array(items: Iterable, depth: int = 0) -> Iterator[str]:
    """A pretty array, item by item, as it stands within so many levels; letters kept as they are."""
    pad, first = " " * 2 * (depth + 1), True
    for x in items:
        yield ("[\n" if first else ",\n") + pad + json.dumps(x, ensure_ascii=False, indent=2).replace("\n", "\n" + pad)
        first = False
    yield "[]" if first else "\n" + pad[2:] + "]"


def write_json_array(rows: DataFrame, path: str) -> None:
    """One pretty array in order of seq, letters kept as they are. The rows go through the driver a partition at a time."""
    order = rows.orderBy("seq").drop("seq") if "seq" in rows.columns else rows
    write_text(rows.sparkSession, path, json_array(json.loads(x) for x in order.toJSON().toLocalIterator()))


def preview(records: DataFrame, n: int = 5) -> DataFrame:
    """The first records as lines: headword, part of speech, the translation's first 50 characters, the literal meaning."""
    literal = F.when(F.col("Literal_Meaning") != "", F.concat(F.lit(" [lit: "), F.col("Literal_Meaning"), F.lit("]"))).otherwise("")
    line = F.concat("Headword_Phrase", F.lit(" ("), "POS", F.lit("): "), F.substring("Translation_RU", 1, 50), literal)
    return records.orderBy("seq").limit(n).select("seq", line.alias("line"))


def write_files(files: DataFrame, folder: str) -> None:
    """Binary files (name, content) into a folder of any file system, from the executors."""
    parts.write_files(files, folder)
