"""Best-fit packing of tokenised documents by minimum bin slack.

Method: per bin, the longest piece left is placed and a subset-sum dynamic program on a bitset (one big integer)
over the lengths left finds the fullest feasible combination of what still fits, longest pieces first; it is
removed, as many times as the pieces of its lengths allow. Only the histogram of lengths is needed for that: at most
`capacity` counts whatever the corpus, and every combination uses up a length, so at most `capacity` programs run on
the driver. Pieces get ranks among their length, counted over salted buckets whose number follows the corpus, and
ranks are mapped to sequences by the plan, whose size depends on the capacity alone.

Token ids are those of the tokenizer file for the whole text. Words are encoded once per worker and kept in a table
of bounded size; a text that the split at ASCII white space could change (combining marks, special tokens) is
encoded whole.

Defined cases: a null or empty text is the end token alone. Repeated rows are packed each. A null doc_id is packed
and stays null. An empty table gives an empty result. Only pieces beyond the capacity are cut, texts of any length
are encoded whole. Other columns are ignored by the operator; the stage returns the packed pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, slices, stored, table

CAPACITY = 4096
END = 1
#: Pieces of a length that one task ranks, about.
BUCKET = 50_000
#: Words that a worker keeps the ids of, at most.
CACHE = 150_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: With a number that spreads equal pieces over buckets.
NUMBERED = f"{PIECES}, nr long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level tokenizers for the 256 bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder(dict):
    """Bytes of a word -> its ids as little-endian unsigned 32-bit integers; ids() for whole texts."""

    _TAIL = re.compile(rb"(?<=[a-z])([!-&(-/:-@\[-`{-~]+)(?=[ \n])")
    #: Lead bytes of characters from U+0300 on, where composition and context matter.
    _FAR = re.compile(rb"[\xcc-\xff]")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            ids = [t.id for t in self.model.tokenize(word.lower().decode())]
        else:
            text = word.decode()
            low = text.lower()
            if low.isalpha() and not self._FAR.search(word):
                ids = [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
        got = np.array(ids, "<u4").tobytes()
        if len(self) < CACHE:
            self[word] = got
        return got

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text:
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if not self._FAR.search(text):
            text = self._TAIL.sub(rb" \1", text.lower())
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document's ids with the end token: columns of NUMBERED. To be stored: numbers are a task's own."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([END], "<u4").tobytes()
        nr = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            rows = []
            names = b.column(0).to_pylist()
            for at, part in slices(b.column(1)):
                for i, t in zip(names[at : at + len(part)], part, strict=True):
                    ids = (enc.ids(t) if t else b"") + end
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k : k + 4 * capacity]
                        rows.append((i, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), nr))
                        nr += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in NUMBERED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), NUMBERED)


def fullest(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of lengths with counts (longest first), how many of each to take to fill room as far as possible."""
    steps, bits, mask = [], 1, (1 << (room + 1)) - 1
    for length, count in lengths:
        if length > room:
            continue
        left, take = min(count, room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            take *= 2
        if bits >> room & 1:
            break
    at, out = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) of bins until no piece is left."""
    left, bins = {n: c for n, c in histogram.items() if c}, []
    order = sorted(left, reverse=True)
    while left:
        while order[0] not in left:
            order.pop(0)
        longest = order[0]
        rest = [(n, left[n] - (n == longest)) for n in order if n in left and n <= capacity - longest and left[n] - (n == longest)]
        one = fullest(rest, capacity - longest) if rest else {}
        one[longest] = one.get(longest, 0) + 1
        times = min(left[n] // k for n, k in one.items())
        bins.append((times, one))
        for n, k in one.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return bins


def _ranges(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, offset in a bin), by length and rank."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for times, one in bins:
        offset = 0
        for n in sorted(one, reverse=True):
            out.append((n, rank.get(n, 0), one[n], sequence, offset))
            rank[n] = rank.get(n, 0) + one[n] * times
            offset += n * one[n]
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (columns of NUMBERED, stored) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    at = spark.sparkContext.broadcast(_ranges(plan(histogram, capacity)))
    salts = max(64, -(-sum(histogram.values()) // BUCKET))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("nr"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("nr")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = at.value
        keys = (ranges[:, 0] << 48) + ranges[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            if len(length):
                r = ranges[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
                n = rank - r[:, 1]
                columns = [b.column(i) for i in range(5)] + [pa.array(r[:, 3] + n // r[:, 2]), pa.array(r[:, 4] + n % r[:, 2] * length)]
                yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(token_pieces(docs, path, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences. Defined cases: as above; other columns, whatever their names, go."""
    return pack_documents(docs.select("doc_id", "text"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
SQL: dict[str, str] = {}
