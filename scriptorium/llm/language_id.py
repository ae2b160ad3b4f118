"""Language identification by rank-order profiles.

Method: the n-grams of a text are its letters (lower case), each with its left neighbour, and each with both
neighbours; a word's edge counts as a neighbour. A language's profile ranks the PROFILE most frequent n-grams of all
its training texts. A document's own most frequent n-grams are ranked alike, and its distance to a language is the
sum of the differences of ranks, PROFILE for an n-gram that the profile lacks. The least distance wins, ties by the
language's name. score is 1 - distance / the greatest possible.

Counts cover all training texts and whole texts. Ties in rank go by code points, so profiles don't depend on how
rows are dealt. The driver and each task hold PROFILE n-grams of 16 bytes for each language; a document costs what its
n-grams' occurrences in profiles do, so any number of languages works, one for each typing error included.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is any text if nothing was learned.
Rows with null lang or text aren't learned from. Repeated rows count each. An empty table gives an empty result.
Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, slices, stored, table

PROFILE = 300
#: Counts that a task holds before it passes them on, and cells of distances that are computed together.
HELD, CELLS = 2_000_000, 4_000_000
#: Codes up to which n-grams are counted in a dense array instead of by sorting.
DENSE = 1 << 22

_letter = np.full(0x110000, 2, np.uint8)


def _letters(codes: np.ndarray) -> np.ndarray:
    kind = _letter[codes]
    if (new := kind == 2).any():
        for c in np.unique(codes[new]).tolist():
            _letter[c] = chr(c).isalpha()
        kind = _letter[codes]
    return kind.astype(bool)


class Grams:
    """N-grams of several texts as small integers whose order is that of their code points."""

    def __init__(self, docs: list[bytes]) -> None:
        raw = [np.frombuffer(d.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for d in docs]
        size = np.array([len(r) + 1 for r in raw])
        codes = np.zeros(int(size.sum()) + 1, np.int64)
        at = np.cumsum(size) - size + 1
        for a, r in zip(at.tolist(), raw, strict=True):
            codes[a : a + len(r)] = r
        inside = _letters(codes)
        inside[0] = False
        present = np.zeros(0x110000, bool)
        present[codes[inside]] = True
        self.alphabet = np.flatnonzero(present)
        self.base = len(self.alphabet) + 2
        small = np.zeros(0x110000, np.int32)
        small[self.alphabet] = np.arange(2, self.base)
        kind = np.int32 if self.base**3 < 2**31 else np.int64
        digit = np.where(inside, small[codes], 1).astype(kind)  # 1: a word's edge
        where = np.flatnonzero(inside)
        left, own = digit[where - 1], digit[where]
        right = digit[np.minimum(where + 1, len(digit) - 1)]
        b = kind(self.base)
        self.grams = (own, left * b + own, (left * b + own) * b + right)
        self.first = np.searchsorted(where, np.concatenate((at, [len(codes)])))

    def packed(self, grams: np.ndarray) -> np.ndarray:
        """As longs of three code points, the same for any texts."""
        g = grams.astype(np.int64)
        far = np.concatenate(([0, 1], self.alphabet + 2))
        return (far[g // self.base**2] << 42) | (far[g // self.base % self.base] << 21) | far[g % self.base]

    def of(self, a: int, b: int) -> np.ndarray:
        """All n-grams of the texts a to b - 1."""
        x, y = self.first[a], self.first[b]
        return np.concatenate([g[x:y] for g in self.grams])

    def counted(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.base**3 <= DENSE and len(grams) > 50_000:
            n = np.bincount(grams)
            at = np.flatnonzero(n)
            return at, n[at]
        return np.unique(grams, return_counts=True)

    def top(self, k: int, most: int) -> np.ndarray:
        """The most frequent n-grams of a text, by falling count, then by code points."""
        g = np.sort(self.of(k, k + 1))
        if not len(g):
            return g
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        n = np.diff(np.append(edge, len(g)))
        order = np.arange(len(edge)) - (n.astype(np.int64) << 32)
        if len(order) > most:
            order = np.partition(order, most - 1)[:most]
        order.sort()
        return g[edge[order & 0xFFFFFFFF]]


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs: lang, text. Counts of n-grams by language, over all rows: lang, gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                u, n = merged(parts)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(u)), pa.array(u), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            u, i = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return u, np.bincount(i, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)

        for b in batches:
            lang = b.column(0).to_pylist()
            order = sorted(range(len(lang)), key=lang.__getitem__)
            for at, part in slices(b.column(1).take(pa.array(order, pa.int64()))):
                grams, own = Grams(part), [lang[i] for i in order[at : at + len(part)]]
                a = 0
                while a < len(own):
                    z = a
                    while z < len(own) and own[z] == own[a]:
                        z += 1
                    u, n = grams.counted(grams.of(a, z))
                    parts = held.setdefault(own[a], [])
                    parts.append((grams.packed(u), n))
                    if sum(len(p[0]) for p in parts) > 500_000:
                        held[own[a]] = [merged(parts)]
                    a = z
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                    yield from passed()
        yield from passed()

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return rows.mapInArrow(released(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's n-grams by rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = stored(gram_counts(docs).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most), "profiles")
    got = top.orderBy("lang", "r").select("lang", "gram").toArrow()  # `most` rows for each language
    if not got.num_rows:
        return {}
    lang, gram = got.column("lang").combine_chunks().dictionary_encode(), got.column("gram").to_numpy()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    own = lang.indices.to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return {lang.dictionary[int(own[a])].as_py(): gram[a:z] for a, z in zip(edge, [*edge[1:], len(own)], strict=True)}


def identify(docs: DataFrame, learned: dict[str, np.ndarray], most: int = PROFILE) -> DataFrame:
    """docs' columns, lang_pred and score. No shuffle; only the text crosses to Python."""
    names = sorted(learned)
    # by n-gram: the languages whose profiles have it, and its rank there
    grams_ = np.concatenate([learned[n] for n in names]) if names else np.zeros(0, np.int64)
    by = np.argsort(grams_, kind="stable")
    which = np.repeat(np.arange(len(names), dtype=np.int32), [len(learned[n]) for n in names])[by] if names else np.zeros(0, np.int32)
    rank = np.concatenate([np.arange(len(learned[n]), dtype=np.int32) for n in names])[by] if names else np.zeros(0, np.int32)
    known, first = np.unique(grams_[by], return_index=True)
    held = docs.sparkSession.sparkContext.broadcast((known, np.append(first, len(by)), which, rank))

    def nearest(grams: Grams, tops: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the nearest language, and what its distance lacks to the greatest possible one."""
        known, first, which, rank = held.value
        size = np.array([len(t) for t in tops])
        g = grams.packed(np.concatenate(tops))
        doc, own = np.repeat(np.arange(len(tops)), size), np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        met = np.flatnonzero(known[at] == g)
        at, n = at[met], np.diff(first)[at[met]]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
        gain = most - np.abs(rank[place] - np.repeat(own[met], n))
        total = np.bincount(np.repeat(doc[met], n) * len(names) + which[place], weights=gain, minlength=len(tops) * len(names)).reshape(len(tops), -1)
        best = total.argmax(axis=1)
        return best, total[np.arange(len(tops)), best]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
        for column in batches:
            pred, score = [], []
            for _, part in slices(column):
                grams = Grams(part)
                tops = [grams.top(k, most) for k in range(len(part))]
                step = max(CELLS // max(len(names), 1), 1)
                for a in range(0, len(part), step):
                    some = tops[a : a + step]
                    best, gain = nearest(grams, some) if names and any(map(len, some)) else (np.zeros(len(some), int), np.zeros(len(some)))
                    for t, j, x in zip(some, best.tolist(), gain.tolist(), strict=True):
                        und = not names or not len(t)
                        pred.append("und" if und else names[j])
                        score.append(0.0 if und else x / (len(t) * most))
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], fields=list(kind))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.arrow_udf(run, "lang string, score double")("text").alias("_l")).select(
        *(F.col(f"`{c}`") for c in rest), F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score")
    )


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = profiles(docs.where(~held_out()).select("lang", "text"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), learned).drop("text")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
