"""Substring deduplication: content-defined chunks by a gear rolling hash as anchors, decided on exact passages.

Method: a gear hash rolls over the words (64 bits, 4 a word, hence of the last 16 words). A passage of MIN_WORDS words has
the least hash in it as its anchor; consecutive passages with one anchor form a chunk. As the anchor depends on nothing
but the passage, a passage that stands in two documents has the same anchor in both, wherever it begins. Each chunk
(anchor and digest of all its words) is grouped over the corpus, and its place of least document is its source. Where one
anchor has different chunks, as at both ends of a repeat, all passages of the chunks' first holders are compared one by
one. Passages and chunks that follow each other both in the document and in its source merge into a span: a piece of the
document that stands in source_doc_id word for word. So every passage of at least MIN_WORDS words that an earlier document
has is found, to the word, and nothing else.

Defined cases: a null text or one of fewer than MIN_WORDS words has no passage. White space between words doesn't count.
A document is a pair of doc_id and text: rows that share a doc_id but not the text are documents of their own, as are rows
without doc_id, which come after all others; of equal doc_ids the least hash of the text comes first. Rows that are equal
in both are one document. Repeats inside one document are no duplicates. Exact copies under several ids are reported whole
but in the document of least id. Spans of one document overlap where its parts have different sources; the stage cuts their
union. An empty table gives an empty result. A text of any length is read
whole. Other columns are ignored by the operator and kept by the stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _powers, mixed, released, settled, slices, stored, table, texts, word_hashes, words_of

#: Words that a passage has at least (over 50), and words that the rolling hash sees.
MIN_WORDS, SEEN = 51, 16
PLACE = "m long, d long, doc_id long, h long, pos int, n int, start long, stop long"
#: Stands for a null doc_id: such rows come after all others.
NO_ID = 2**63 - 1
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))


def gear(words: np.ndarray) -> np.ndarray:
    """h[i] = 16 h[i-1] + words[i] modulo 2^64, all at once: of the last SEEN words. The first SEEN - 1 saw fewer."""
    h = words
    for s in (1, 2, 4, 8):
        add = h[:-s] << np.uint64(4 * s)
        h = h.copy()
        h[s:] += add
    return h


def anchors(words: np.ndarray, size: int) -> np.ndarray:
    """For each passage of size words (by its first word), the least mixed gear hash of SEEN words in it."""
    m, have, want = mixed(gear(words)[SEEN - 1 :]), 1, size - SEEN + 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


class _Digests:
    """Digests of any runs of words, from sums of their hashes times powers."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words) + 1
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(n)[: n - 1], dtype=np.uint64)))
        back = np.full(n, _INVERSE)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def of(self, first: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[first + count] - self.sums[first]) * self.back[first] + np.asarray(count, np.uint64))


def _batch(m: np.ndarray, d: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    types = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64]
    arrays = [m.view(np.int64), d.view(np.int64), *(np.asarray(c, t) for c, t in zip(columns, types, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in arrays], [x.split()[0] for x in PLACE.split(", ")])


def _placed(part: list[bytes], ids: np.ndarray, h: np.ndarray, size: int, wanted: list | None = None) -> Iterator[pa.RecordBatch]:
    """The chunks of some texts (n passages each), or by themselves (n = 1) the passages of those that are wanted."""
    buf, starts, ends, first = words_of(part)
    if len(starts) < size:
        return
    words = word_hashes(buf, starts, ends)
    m, digests = anchors(words, size), _Digests(words)
    base = np.cumsum([0, *(len(t) + 1 for t in part)])
    at, n, of = [], [], []
    for k, (a, z) in enumerate(zip(first[:-1].tolist(), (first[1:] - size + 1).tolist(), strict=True)):
        if z <= a:
            continue
        if wanted is None:
            cut = a + np.concatenate(([0], np.flatnonzero(np.diff(m[a:z])) + 1, [z - a]))
            at.append(cut[:-1])
            n.append(np.diff(cut))
        else:
            runs = [np.arange(a + w["pos"], a + w["pos"] + w["n"]) for w in wanted[k] or ()]
            at.append(np.concatenate(runs) if runs else np.zeros(0, np.int64))
            n.append(np.ones(len(at[-1]), np.int64))
        of.append(np.full(len(at[-1]), k))
    if at:
        at, n, of = np.concatenate(at), np.concatenate(n), np.concatenate(of)
        yield _batch(m[at], digests.of(at, n + size - 1), ids[of], h[of], at - first[of], n, starts[at] - base[of], ends[at + n + size - 2] - base[of])


def _id(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id and h name a document."""
    return docs.where("text IS NOT NULL").select(_id(), F.xxhash64("text").alias("h"), "text")


def chunk_rows(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """A row for each chunk of each document: anchor m, digest d, doc_id, h (of the text), first word, passages, start and end byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for at, part in slices(batch.column(2)):
                yield from _placed(part, ids[at : at + len(part)], h[at : at + len(part)], size)

    return _named(docs).mapInArrow(released(run), PLACE)


def passage_rows(docs: DataFrame, wanted: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """As chunk_rows, for each passage by itself of the chunks in wanted (doc_id, h, pos, n)."""
    asked = wanted.groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "n")).alias("wanted"))
    here = _named(docs).join(asked, ["doc_id", "h"]).select("doc_id", "h", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for at, part in slices(batch.column(2)):
                yield from _placed(part, ids[at : at + len(part)], h[at : at + len(part)], size, batch.column(3).slice(at, len(part)).to_pylist())

    return here.mapInArrow(released(run), PLACE)


def _sources(rows: DataFrame) -> DataFrame:
    """For each m and d, the place in the least document (kept) and the greatest document (other)."""
    return rows.groupBy("m", "d").agg(F.min(F.struct("doc_id", "h", "pos")).alias("kept"), F.max(F.struct("doc_id", "h")).alias("other"))


#: The document of the source, of a row, and of what else has it.
_KEPT, _OWN = "struct(kept.doc_id, kept.h)", "struct(doc_id, h)"


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of at least min_words words that stand in an earlier document as well: doc_id, h, start, stop (bytes),
    n_words, n_chunks (chunks and single passages merged), source_doc_id."""
    if min_words < SEEN:
        raise ValueError(f"a passage has {SEEN} words at least")
    made = stored(chunk_rows(docs, min_words), "chunks")
    first = stored(_sources(made), "sources")
    # anchors with different chunks in different documents
    open_ = first.groupBy("m").agg(F.min(F.expr(_KEPT)).alias("lo"), F.max(F.expr(_KEPT)).alias("hi")).where("lo < hi").select("m", F.lit(True).alias("open"))
    shared = first.join(stored(open_, "open"), "m", "left").where(f"open OR {_KEPT} < other").drop("other")
    # as stored tables these are shuffled for the join by themselves, which lets adaptive execution split a hot partition
    met = stored(made.join(stored(shared, "shared"), ["m", "d"]).where(f"{_OWN} > {_KEPT} OR open AND {_OWN} = {_KEPT}"), "met").drop("m", "d")
    alone = stored(passage_rows(docs, met.where(f"{_OWN} = {_KEPT}").select("doc_id", "h", "pos", "n"), min_words), "passages")
    repeated = stored(_sources(alone).where(f"{_KEPT} < other").drop("other"), "repeated")
    single = alone.join(repeated, ["m", "d"]).where(f"{_OWN} > {_KEPT}").drop("m", "d")
    places = met.where(f"{_OWN} > {_KEPT}").drop("open").unionByName(single).withColumn("diagonal", F.col("pos") - F.col("kept.pos"))
    key = ["doc_id", "h", "source_doc_id", "source_h", "diagonal"]
    places = places.select("*", F.col("kept.doc_id").alias("source_doc_id"), F.col("kept.h").alias("source_h")).drop("kept").distinct()
    order = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = places.withColumn("g", F.col("pos") + F.col("n") - F.sum("n").over(order))
    out = runs.groupBy(*key, "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.sum("n") + min_words - 1).alias("n_words"), F.count(F.lit(1)).alias("n_chunks"))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "h", "start", "stop", "n_words", "n_chunks", F.nullif("source_doc_id", F.lit(NO_ID)).alias("source_doc_id"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut out of their texts (n_chars set anew where there is such a column); texts left without a word go."""
    # columns go by position, so that any names do
    names = docs.columns
    own = {names[i]: f"_{i}" for i in range(len(names))}
    cut = spans.groupBy(_id().alias("of"), F.col("h").alias("of_h")).agg(F.collect_set(F.struct("start", "stop")).alias("cut"))
    here = docs.toDF(*own.values())
    text = F.col(own["text"])
    here = here.join(cut, (_id(own["doc_id"]) == F.col("of")) & (F.xxhash64(text) == F.col("of_h")), "left")

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, cuts in batches:
            out = []
            for t, c in zip(texts(text), cuts.to_pylist(), strict=True):
                at, rest = 0, []
                for x in sorted(c or (), key=lambda x: x["start"]):
                    if not at or t[at : x["start"]].strip():
                        rest.append(t[at : x["start"]].rstrip(b" "))
                    at = max(at, x["stop"])
                out.append(b" ".join([*rest, t[at:].lstrip(b" ")]).strip().decode() if rest else None)  # null: no span
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # Only texts that may be edited cross to Python, and once: the optimizer may not repeat what isn't deterministic.
    edited = F.arrow_udf(run, "string").asNondeterministic()
    here = here.withColumn("new", edited(F.when(F.col("cut").isNotNull(), text), "cut")).where(F.col("new").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return here.select(*(F.when(F.col("new").isNotNull(), new[c]).otherwise(F.col(k)).alias(c) if c in new else F.col(k).alias(c) for c, k in own.items()))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(repeated_spans)(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("h")


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated spans out of all documents but the first that has them. Defined cases: as above; a text that is left
    without a word goes, with its row; a text without a repeated span, a null one too, stays as it is."""
    return without_spans(docs, settled(repeated_spans)(docs.select("doc_id", "text")))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL: dict[str, str] = {}
