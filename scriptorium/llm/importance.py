"""Quality classifier by importance resampling.

Method: two generative models of hashed n-grams (words and word pairs in BUCKETS buckets, with add-one smoothing),
one of target texts and one of all raw texts. A text's log weight is the sum over its n-grams of the log ratio of the
models. With standard Gumbel noise added, the SELECT share of texts with the greatest sums is a sample without
replacement, by weight (Gumbel top-k). The noise is a function of doc_id and a seed, so a run can be repeated.

The raw model covers all documents. The target model is fitted on at most SAMPLE texts labelled good (those with
the least hashes). The k-th greatest sum is found exactly by radix selection on counts; only counts reach the driver.

Defined cases: a null, empty or wordless text has log weight 0. Repeated rows count each; rows that share a doc_id
share the noise, and equal sums at the limit are all selected. Without target texts all weights are 0 and the sample
is uniform. A null doc_id has noise of its own. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, stored, table, windows, word_hashes, words_of

BUCKETS = 1 << 15
SAMPLE = 20_000
#: Share of the documents that is selected.
SELECT = 0.75
SEED = 17
#: Steps of a sum; the radix digits of the selection.
STEP, DIGIT = 1 << 20, 14


def hashed_grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of several texts, grouped by text, and the number of each text's."""
    buf, starts, ends, first = words_of([d.lower() for d in docs])
    h = word_hashes(buf, starts, ends)
    n = np.diff(first)
    pairs = windows(h, 2) if len(h) > 1 else h[:0]
    inside = np.ones(len(pairs), bool)
    inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(h))] - 1] = False
    doc = np.repeat(np.arange(len(docs)), n)
    value = np.concatenate((h, pairs[inside])) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    which = np.concatenate((doc, doc[:-1][inside] if len(h) > 1 else doc[:0]))
    order = np.argsort(which, kind="stable")
    return value[order].astype(np.int64), np.bincount(which, minlength=len(docs))


def model_counts(docs: DataFrame) -> DataFrame:
    """Counts of buckets over all texts: bucket, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, part in slices(b.column(0)):
                total += np.bincount(hashed_grams(part)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.where("text IS NOT NULL").select("text").mapInArrow(released(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame) -> np.ndarray:
    """The log ratio of the two models for each bucket."""
    out = []
    for df in (target, raw):
        n = np.zeros(BUCKETS)
        for r in model_counts(df).collect():  # at most BUCKETS rows
            n[r.bucket] = r.n
        out.append(n)
    if not out[0].any():
        return np.zeros(BUCKETS)
    p, q = ((n + 1) / (n.sum() + BUCKETS) for n in out)
    return np.log(p) - np.log(q)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs: doc_id, text. Gives doc_id, n_grams, log_weight."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n, w = [], []
            for _, part in slices(column):
                g, size = hashed_grams(part)
                total = np.concatenate(([0.0], np.cumsum(held.value[g])))
                end = np.cumsum(size)
                n.append(size)
                w.append(total[end] - total[end - size])
            kinds = [pa.field("n", pa.int64()), pa.field("w", pa.float64())]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n).astype(np.int64)) if n else pa.array([], pa.int64()), pa.array(np.concatenate(w)) if w else pa.array([], pa.float64())], fields=kinds)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.select("doc_id", F.arrow_udf(run, "n long, w double")("text").alias("_w")).select("doc_id", F.col("_w.n").alias("n_grams"), F.round("_w.w", 6).alias("log_weight"))


def gumbel(column: str = "doc_id", seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_greatest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest value of a column of longs: counts by leading digits, then within the digit found."""
    if k <= 0:
        return None
    shift, low, high = 3 * DIGIT, None, None
    left = k
    while True:
        part = df if low is None else df.where((F.col(column) >= low) & (F.col(column) <= high))
        digits = part.groupBy(F.shiftright(column, shift).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("d")).collect()
        for r in digits:
            if left <= r.n:
                break
            left -= r.n
        else:
            return None
        low, high = r.d << shift, ((r.d + 1) << shift) - 1
        if not shift:
            return low
        shift -= DIGIT


def resample(docs: DataFrame, labels: DataFrame, share: float = SELECT, sample: int = SAMPLE) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality. A row for each document: doc_id, n_grams, log_weight, kept."""
    good = labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    target = docs.join(F.broadcast(good), "doc_id", "left_semi")  # at most `sample` numbers
    weighed = weigh(docs, log_ratios(target, docs))
    summed = stored(weighed.withColumn("q", F.round((F.col("log_weight") + gumbel()) * STEP).cast("long")), "weights")
    limit = kth_greatest(summed, "q", math.ceil(share * summed.count()))
    return summed.select("doc_id", "n_grams", "log_weight", (F.col("q") >= limit if limit is not None else F.lit(False)).alias("kept"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_importance_resampling": op9_importance_resampling}
SQL: dict[str, str] = {}
