"""Vector code compression: product codes by Lloyd rounds on partition-local heaps (heap Lloyd).

Method: a vector's components become whole numbers, and it is cut into PARTS equal parts; each part position has a codebook
of ENTRIES entries. The first assignment scans all entries for every part, and keeps the slack between its distances to
the second nearest (lower bound) and the nearest entry (upper bound). Vectors are stored in blocks; a block holds one heap
per part position and entry, keyed by the slack plus the entry's cumulative drift when it was measured. An update moves
entries: each entry's cumulative drift grows by its own move and the greatest move of the others. The next assignment
pops from every heap just the parts whose key the drift has passed, as only their bounds are violated; these are scanned
exactly and pushed to the heap of their entry. All other parts keep their entry, which is proven to be still the nearest.

Codebooks (ENTRIES times the vector's length) and sums for their updates are all that crosses the driver. Distances are
whole numbers, exact in float64 or else computed in int64; the margin of the drift covers the rounding of square roots,
so codes are those of full scans, ties to the lower index included. Blocks of bounded size are stored between rounds, and
a lost task rebuilds its blocks from the stored ones.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are dropped; a null vec_id is kept, last
in order. Rows of equal vec_id are rows of their own, in order of their components. A vector shorter than the longest one is
read as if zeros followed, and so is the last part if the length is no multiple of PARTS; an empty vector is all zeros.
A component counts as MOST at most (values beyond 65,536), so that sums can't overflow. With fewer rows than
ENTRIES codebooks are smaller. Null labels are one label. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import same_keys
from .common import released, settled, stored, table

PARTS, ENTRIES, ROUNDS, UNIT = 16, 64, 2, 256
#: The greatest scaled component.
MOST = 1 << 24
#: Components of a block's vectors together, and of the parts that are scanned together.
BLOCK, SCANNED = 1 << 19, 1 << 17
#: More than the error of two square roots and their sums.
MARGIN = 1e-6

_STATE = "vec_ids array<long>, labels array<int>, vectors binary, codes binary, keys binary, members binary, sizes binary, moved array<long>"


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: the kept vectors in whole numbers. All in the JVM."""
    given = F.col("embedding").cast("array<double>")
    finite = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(given, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e6)), F.lit(-1e6)) * UNIT), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("x"))


def nearest(parts: np.ndarray, book: np.ndarray, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of parts (n, w) to the entries of book (k, w): (n, k), or to the entry mine of each: (n,). Exact."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if mine is not None:
        d = parts.astype(np.int64) - book[mine]
        return np.einsum("nw,nw->n", d, d)
    if 4 * most * most * max(parts.shape[1], 1) < 1 << 53:  # whole numbers that float64 holds
        p, b = parts.astype(float), book.astype(float)
        return (p * p).sum(axis=1)[:, None] - 2 * p @ b.T + (b * b).sum(axis=1)
    out = np.empty((len(parts), len(book)), np.int64)
    for k, entry in enumerate(book.astype(np.int64)):
        d = parts - entry
        out[:, k] = np.einsum("nw,nw->n", d, d)
    return out


def scanned_exactly(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part: its nearest entry (the lower of equal ones), and the slack between the second nearest and the nearest."""
    code, slack = np.empty(len(parts), np.uint8), np.empty(len(parts))
    for a in range(0, len(parts), step := max(1, SCANNED // max(1, len(book)))):
        d = nearest(parts[a : a + step], book)
        best = d.argmin(axis=1)
        code[a : a + step] = best
        if len(book) == 1:
            slack[a : a + step] = np.inf
        else:
            two = np.partition(d, 1, axis=1)[:, :2]
            slack[a : a + step] = np.sqrt(two[:, 1].astype(float)) - np.sqrt(two[:, 0].astype(float))
    return code, slack


class Heaps:
    """Binary heaps side by side, least key first: heap h holds keys[start[h] : start[h + 1]] in heap order, and its members."""

    def __init__(self, keys: np.ndarray, members: np.ndarray, sizes: np.ndarray):
        self.keys, self.members, self.sizes = keys, members, sizes

    @classmethod
    def of(cls, heap: np.ndarray, keys: np.ndarray, members: np.ndarray, n: int) -> Heaps:
        """heap: which of the n heaps each member is in. Keys in ascending order are in heap order."""
        order = np.lexsort((members, keys, heap))
        return cls(keys[order], members[order], np.bincount(heap, minlength=n).astype(np.int32))

    def pop(self, limits: np.ndarray) -> np.ndarray:
        """Removes every member whose key is at most its heap's limit; gives their places before removal.

        From the tops down, all heaps together: below a key beyond the limit there is none within it."""
        start = np.cumsum(self.sizes) - self.sizes
        heap = np.flatnonzero(self.sizes > 0)
        at, found = np.zeros(len(heap), np.int64), []
        while len(heap):
            due = self.keys[start[heap] + at] <= limits[heap]
            heap, at = heap[due], at[due]
            found.append(start[heap] + at)
            heap, at = np.concatenate((heap, heap)), np.concatenate((2 * at + 1, 2 * at + 2))
            inside = at < self.sizes[heap]
            heap, at = heap[inside], at[inside]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def push(self, popped: np.ndarray, heap: np.ndarray, keys: np.ndarray) -> Heaps:
        """The heaps with the members at popped in other heaps and with other keys. Only heaps that lose or gain some are ordered anew."""
        own = np.repeat(np.arange(len(self.sizes)), self.sizes)
        stays = np.ones(len(own), bool)
        stays[popped] = False
        moved = self.members[popped]
        changed = np.zeros(len(self.sizes), bool)
        changed[own[popped]] = changed[heap] = True
        again = changed[own] & stays
        part = Heaps.of(np.concatenate((own[again], heap)), np.concatenate((self.keys[again], keys)), np.concatenate((self.members[again], moved)), len(self.sizes))
        sizes = np.where(changed, part.sizes, self.sizes).astype(np.int32)
        out = Heaps(np.empty(len(own)), np.empty(len(own), self.members.dtype), sizes)
        now = np.repeat(changed, sizes)
        out.keys[now], out.members[now] = part.keys, part.members
        out.keys[~now], out.members[~now] = self.keys[~changed[own]], self.members[~changed[own]]
        return out


class Codebooks:
    """books: (parts, entries, w); drift: (parts, entries), cumulative."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.drift = np.zeros(books.shape[:2])

    def moved(self, n: np.ndarray, sums: np.ndarray) -> Codebooks:
        """With every used entry at the mean of its parts, rounded down, and the drift that this adds to each."""
        used = n > 0
        out = Codebooks(np.where(used[:, :, None], sums // np.maximum(n, 1)[:, :, None], self.books))
        move = np.sqrt(((out.books - self.books).astype(float) ** 2).sum(axis=2))
        most = np.sort(move, axis=1)
        # the greatest move of the others: the second greatest for the entry that moves most
        others = np.where(np.arange(move.shape[1]) == move.argmax(axis=1)[:, None], most[:, -2:-1] if move.shape[1] > 1 else 0.0, most[:, -1:])
        out.drift = self.drift + move + others
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _sums(parts: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """parts (n, PARTS, w), codes (n, PARTS): for each position and entry the number of its parts and their sums, flat."""
    n, m, w = parts.shape
    out = np.zeros((m, entries, w + 1), np.int64)
    for p in range(m):
        np.add.at(out[p], codes[:, p], np.concatenate((np.ones((n, 1), np.int64), parts[:, p]), axis=1))
    return out


def _block(vec_ids, labels, x: np.ndarray, codes: np.ndarray, heaps: Heaps) -> pa.RecordBatch:
    one = lambda a, kind: pa.array([a], kind)
    columns = [one(vec_ids, pa.list_(pa.int64())), one(labels, pa.list_(pa.int32())), *(one(a.tobytes(), pa.binary()) for a in (x, codes, heaps.keys, heaps.members, heaps.sizes)), one(None, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STATE.split(", ")])


def _total(total: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], [c.split()[0] for c in _STATE.split(", ")])


def _first(books: Codebooks, w: int):
    """Blocks from batches of vec_id, label, x, with heaps from a full scan; at the end the sums of all."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, total = books.books.shape[1], None
        for batch in batches:
            for a in range(0, batch.num_rows, step := max(1, BLOCK // max(1, PARTS * w))):
                rows = batch.slice(a, step)
                lists = rows.column("x")
                lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.zeros((rows.num_rows, PARTS * w), np.int32)
                x[np.repeat(np.arange(len(lens)), lens), np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)] = lists.flatten().to_numpy()
                parts = x.reshape(len(x), PARTS, w)
                codes, slack = (np.stack(c, axis=1) for c in zip(*(scanned_exactly(parts[:, p], books.books[p]) for p in range(PARTS)), strict=True))
                heap = (np.arange(PARTS) * entries + codes).ravel()
                heaps = Heaps.of(heap, slack.ravel(), np.arange(len(heap), dtype=np.int32), PARTS * entries)
                yield _block(rows.column("vec_id").to_pylist(), rows.column("label").to_pylist(), x, codes, heaps)
                sums = _sums(parts, codes, entries)
                total = sums if total is None else total + sums
        if total is not None:
            yield _total(total)

    return run


def _opened(row: dict, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(row["vectors"], np.int32).reshape(n, PARTS, w)
    return x, np.frombuffer(row["codes"], np.uint8).reshape(n, PARTS).copy()


def _rounds(books: Codebooks, w: int):
    """Blocks after the drift: violated parts are popped, scanned exactly and pushed; at the end what this changes in the sums."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, total = books.books.shape[1], None
        drift = books.drift.ravel()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                n = len(row["vec_ids"])
                x, codes = _opened(row, w, n)
                heaps = Heaps(np.frombuffer(row["keys"]), np.frombuffer(row["members"], np.int32), np.frombuffer(row["sizes"], np.int32))
                popped = heaps.pop(drift + MARGIN)
                if len(popped):
                    who, position = np.divmod(heaps.members[popped].astype(np.int64), PARTS)
                    new, slack = np.empty(len(popped), np.uint8), np.empty(len(popped))
                    for p in range(PARTS):
                        on = position == p
                        new[on], slack[on] = scanned_exactly(x[who[on], p], books.books[p])
                    heap = position * entries + new
                    heaps = heaps.push(popped, heap, slack + drift[heap])
                    change = np.zeros((PARTS, entries, w + 1), np.int64)
                    values = np.concatenate((np.ones((len(who), 1), np.int64), x[who, position]), axis=1)
                    np.add.at(change, (position, new), values)
                    np.subtract.at(change, (position, codes[who, position]), values)
                    codes[who, position] = new
                    total = change if total is None else total + change
                yield _block(row["vec_ids"], row["labels"], x, codes, heaps)
        if total is not None:
            yield _total(total)

    return run


def _coded(books: Codebooks, w: int):
    """A row for each vector: vec_id, label, code, error."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                x, codes = _opened(row, w, n := len(row["vec_ids"]))
                error = sum((nearest(x[:, p], books.books[p], codes[:, p]) for p in range(PARTS)), np.zeros(n, np.int64))
                code = [codes[k].tobytes().hex() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.int32()), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _changes(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The sums of all tasks, position by position: as many rows as codebooks have components."""
    rows = state.where("moved IS NOT NULL").select(F.posexplode("moved").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape, np.int64)
    for r in rows:
        out.ravel()[r.k] = r.v
    return out


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vectors: vec_id, embedding, label. A row for each kept one: vec_id, label, code, error; and the codebooks."""
    rows = scaled(vectors)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    w = -(-width // PARTS)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    start = np.zeros((len(seeds), PARTS * w), np.int64)
    for k, r in enumerate(sorted(seeds, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.x))):
        start[k, : len(r.x)] = r.x
    books = Codebooks(np.ascontiguousarray(start.reshape(len(seeds), PARTS, w).transpose(1, 0, 2)))
    shape = (PARTS, len(seeds), w + 1)
    state = stored(rows.select("vec_id", "label", "x").mapInArrow(_first(books, w), _STATE), "codes")
    sums = _changes(state, shape)
    for _ in range(rounds):
        books = books.moved(sums[:, :, 0], sums[:, :, 1:])
        state = stored(state.where("moved IS NULL").mapInArrow(_rounds(books, w), _STATE), "codes")
        sums += _changes(state, shape)
    return state.where("moved IS NULL").select("vec_ids", "labels", "vectors", "codes").mapInArrow(_coded(books, w), "vec_id long, label int, code string, error long"), books


def decoded(code: str, books: Codebooks) -> np.ndarray:
    """The vector that a code stands for, in whole numbers."""
    return np.concatenate([books.books[p, e] for p, e in enumerate(bytes.fromhex(code))])


@settled
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    found = stored(found, "coded")
    by_label = stored(found.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    digest = F.lit(books.digest() if books else "")
    return same_keys(found, by_label, ["label"], "inner").select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _sql() -> str:
    assign = lambda k, book: f"a{k} AS (SELECT n, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT x.n, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN {book} b USING (p)) GROUP BY n, p)"
    mean = lambda k, book: f"""m{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m FROM (SELECT a.p, a.e, unnest(x.v) AS c, unnest(range(len(x.v))) AS i FROM a{k} a JOIN x USING (n, p)) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.v, b.v) AS v FROM {book} b LEFT JOIN m{k} USING (p, e))"""  # noqa: E731
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS n, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT n, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS v FROM k, range({PARTS}) r(p)),
b0 AS (SELECT p, n - 1 AS e, v FROM x WHERE n <= {ENTRIES}),
{assign(0, "b0")}, {mean(0, "b0")}, {assign(1, "b1")}, {mean(1, "b1")}, {assign(2, "b2")},
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
c AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 JOIN k USING (n) GROUP BY n, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, s"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
