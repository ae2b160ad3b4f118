"""N-gram Jaccard join by multiple-global-order filtering, up to the connected groups of linked documents.

Method: a document is the set of its distinct word shingles (64-bit hashes); documents of equal sets form a class and
one of each class goes on. Two sets that reach the threshold t share a token among the first n - ceil(t n) + 1 of
each, whatever global order sorts the tokens. The first order puts rare tokens first: the FREQUENT most frequent ones
come last, by a table of fixed size, and all others go by the exact number of sets that have them, found by one
exchange of packed tokens. A set whose prefix holds no token of another set is done with. The others' prefixes are
postings; tokens that two classes share there bind classes to a cluster, by connected components, and every link lies
inside one cluster. Clusters are dealt in blocks of bounded size, pairs of blocks where a cluster has more. In a block
a pair is a candidate if the sets' prefixes share a token under that order and under ORDERS - 1 others, and the sizes
allow the threshold; candidates are verified by the exact intersection. Links of a block come out as a spanning forest
and a count for each class, never as pairs.

Exact up to collisions of 64-bit hashes of shingles; sets go by 128 bits. Nothing is capped: work in a cluster of m near copies is m^2 / block in
rows moved, split over blocks.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are their own component.
A text of fewer words than a shingle is one shingle of all its words. Repeated rows are a class. Rows that share a
doc_id count as one document with all their sets. A row without doc_id takes the component of a row with an equal
set, else null. An empty table gives an empty result. Texts of any length are read whole. Other columns are ignored
by the operator and kept by the stage.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mixed, released, slices, stored, table, windows, word_hashes, words_of
from .graph import components

WORDS = 4
#: The threshold in hundredths.
PERCENT = 85
ORDERS = 3
#: Tokens in the table of the most frequent ones, at most. Only the first order, never the result, depends on it.
FREQUENT = 100_000
#: Documents (and tokens) counted together before their frequent tokens are passed on, and the least count passed on.
FLUSH, FLUSH_TOKENS, SEEN = 8_000, 1_000_000, 3
#: Sets that a task remembers to have passed on, at most; beyond, it starts anew.
REMEMBERED = 200_000
#: Tokens that a bucket of the exchange holds, about.
BUCKET = 500_000
#: Tokens (each set counting at least LIGHT) of a block's side: the most and the least. Between, a cluster is dealt in SIDES.
BLOCK, SMALL, SIDES, LIGHT = 64_000, 4_000, 24, 50
#: Bits of the filter that thins documents before they are joined with the clusters: a fixed size.
FILTER_BITS = 1 << 23

_SALT = mixed(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(docs: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, starts, ends, first = words_of([d.lower() for d in docs])
    h = word_hashes(buf, starts, ends)
    s = windows(h, words) if len(h) >= words else h[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(s[a : b - words + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            yield windows(h[a:b], b - a) if b > a else h[:0]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def prefix(s: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set under one of the further orders, each by a hash of its own."""
    p = prefix_size(len(s), percent)
    return s if p >= len(s) else s[np.argpartition(mixed(s ^ _SALT[order]), p - 1)[:p]]


def _key(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def _each(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, part in slices(batch.column("text")):
        for k, s in enumerate(shingle_sets(part, words)):
            yield at + k, s


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """One pass: a row for each document (doc_id, n, k1, k2 of its set), and rows (token, count) of tokens seen often."""
    schema = "doc_id long, n long, k1 long, k2 long, token long, count long"

    def often(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        u, c = u[c >= SEEN].view(np.int64), c[c >= SEEN]
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(u), pa.array(c)], [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for i, s in _each(b, words):
                rows.append((ids[i], len(s), *_key(s), None, None))
                held.append(s)
                size += len(s)
                if len(held) >= FLUSH or size >= FLUSH_TOKENS:
                    yield from often(held)
                    held, size = [], 0
            if rows:
                yield _batch(schema, rows)
        if held:
            yield from often(held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), schema)


_PACKED = "bucket int, flush long, who int, own binary, low binary, high binary, whose binary"
#: What a set carries through the exchange: its class and size, before its frequent tokens.
_OWN = "<qqq"


def _packed(docs: DataFrame, words: int, percent: int, frequent: Broadcast, bits: int) -> DataFrame:
    """For the exchange: by bucket (the first bits of a token) the next 40 bits of many sets' tokens, without frequent
    ones, and the sets' numbers (whose) in their flush; and a row for each set (flush, who) with its class, size and
    frequent tokens. A flush is named by 64 bits of a hash of its sets.

    A task passes a set on once."""

    def flush(held: list[tuple[tuple[int, int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, count = frequent.value
        near = np.zeros(1 << 16, bool)  # spares most tokens the search
        near[(token >> np.uint64(48)).astype(np.int64)] = True
        keys = np.array([k for k, _ in held], np.int64)
        name = int(np.frombuffer(xxhash.xxh3_64_digest(keys.tobytes()), np.int64)[0])
        lens = [len(s) for _, s in held]
        t, who = np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held), dtype=np.uint16), lens)
        often = np.zeros(len(t), bool)
        if len(token):
            may = np.flatnonzero(near[(t >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(token, t[may]), len(token) - 1)
            often[may] = token[at] == t[may]
            number = np.zeros(len(t), np.int64)
            number[may] = count[at]
        end = np.cumsum(lens)
        rows = []
        for i, (a, z) in enumerate(zip((end - lens).tolist(), end.tolist(), strict=True)):
            own = often[a:z]
            f = t[a:z][own]
            if len(f):
                f = f[np.lexsort((f, number[a:z][own]))]
            k1, k2 = keys[i].tolist()
            rows.append((k1 & (1 << bits) - 1, name, i, struct.pack(_OWN, k1, k2, z - a) + f.tobytes(), None, None, None))
            if len(rows) >= 2_000:
                yield _batch(_PACKED, rows)
                rows = []
        t, who = t[~often], who[~often]
        bucket = (t >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        rest, bucket, who = (t >> np.uint64(24 - bits))[order] & np.uint64((1 << 40) - 1), bucket[order], who[order]
        low, high = rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)
        edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist() if len(bucket) else []
        for a, z in pairwise(edge):
            rows.append((int(bucket[a]), name, None, None, low[a:z].tobytes(), high[a:z].tobytes(), who[a:z].tobytes()))
            if len(rows) >= 2_000:
                yield _batch(_PACKED, rows)
                rows = []
        if rows:
            yield _batch(_PACKED, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[tuple[int, int], np.ndarray]] = []
        size = 0
        for b in batches:
            for _, s in _each(b, words):
                if len(s) and (k := _key(s)) not in seen:
                    seen.add(k)
                    held.append((k, s))
                    size += len(s)
                    if len(held) >= FLUSH or size >= FLUSH_TOKENS:
                        yield from flush(held)
                        held, size = [], 0
            if len(seen) > REMEMBERED:
                seen.clear()
        if held:
            yield from flush(held)

    return docs.select("text").mapInArrow(released(run), _PACKED)


_COMMON = "flush long, who int, own binary, df int, token long"


def _common(packed: DataFrame) -> DataFrame:
    """packed, sorted by bucket within partitions: the tokens that several sets have, for each of them (flush, who, df, token); rows of sets as they are."""

    def found(bucket: int, parts: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        t = np.concatenate([np.frombuffer(low, np.uint32) | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)) for _, low, high, _ in parts])
        who = np.concatenate([np.frombuffer(whose, np.uint16) for _, _, _, whose in parts])
        part = np.repeat(np.arange(len(parts)), [len(high) for _, _, high, _ in parts])
        order = np.argsort(t)
        t = t[order]
        edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        n = np.diff(np.append(edge, len(t)))
        df = np.repeat(n, n)
        if (m := df > 1).any():
            order = order[m]
            flush = np.array([p[0] for p in parts], np.int64)[part[order]]
            columns = [pa.array(flush), pa.array(who[order].astype(np.int32)), pa.nulls(len(order), pa.binary()), pa.array(df[m].astype(np.int32)), pa.array(t[m].astype(np.int64) | (bucket << 40))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _COMMON.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            sets = []
            for bucket, flush, who, own, low, high, whose in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    if parts:
                        yield from found(now, parts)
                    now, parts = bucket, []
                if low is None:
                    sets.append((flush, who, own, None, None))
                else:
                    parts.append((flush, low, high, whose))
            if sets:
                yield _batch(_COMMON, sets)
        if parts:
            yield from found(now, parts)

    return packed.mapInArrow(released(run), _COMMON)


def prefixes(docs: DataFrame, words: int, percent: int, frequent: Broadcast, bits: int) -> DataFrame:
    """Classes whose prefix under the first order has tokens that other sets have too: k1, k2, and these tokens (longs, packed)."""
    packed = _packed(docs, words, percent, frequent, bits).repartition("bucket").sortWithinPartitions("bucket")
    by = _common(packed).groupBy("flush", "who").agg(
        F.max("own").alias("own"), F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("df", "token")))).alias("common")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = b.column("own").to_pylist()
            common = b.column("common").combine_chunks() if isinstance(b.column("common"), pa.ChunkedArray) else b.column("common")
            token, at = common.values.field("token").to_numpy(), common.offsets.to_numpy()
            rows = []
            for i, s in enumerate(sets):
                k1, k2, n = struct.unpack_from(_OWN, s)
                f = np.frombuffer(s, np.int64, offset=struct.calcsize(_OWN))
                own = token[at[i] : at[i + 1]]
                first = prefix_size(n, percent) - (n - len(f) - len(own))  # what tokens of its own leave of the prefix
                if first > 0:
                    rows.append((k1, k2, np.concatenate((own[:first], f[: max(first - len(own), 0)])).tobytes()))
            if rows:
                yield _batch("k1 long, k2 long, p binary", rows)

    # copies of a set that several tasks passed on have equal prefixes
    return by.select("own", "common").mapInArrow(released(run), "k1 long, k2 long, p binary").groupBy("k1", "k2").agg(F.max("p").alias("p"))


def _postings(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(p, np.int64) for p in b.column("p").to_pylist()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.repeat(b.column("k1").to_numpy(), [len(x) for x in parts]))], ["token", "k1"])

    return found.select("k1", "p").mapInArrow(released(run), "token long, k1 long")


def thinned(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """docs but for most of the rows whose column is not in ids (none that is in ids goes). The filter has a fixed size."""
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))
    bits = ids.select(at.alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m"))
    field = np.zeros(FILTER_BITS // 64, np.int64)
    for r in bits.collect():  # at most FILTER_BITS / 64 rows
        field[r.w] = r.m
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            i = b.to_numpy(zero_copy_only=False)
            yield pa.array((held.value[i >> 6] >> (i & 63)) & 1 == 1)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(run, "boolean")(at))


def _counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of a with each of b."""
    ta, tb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    common = np.intersect1d(ta, tb)
    out = np.zeros((len(a), len(b)), np.float32)
    ca, cb = np.searchsorted(common, ta), np.searchsorted(common, tb)
    ca[ca == len(common)] = 0
    cb[cb == len(common)] = 0
    oka, okb = (common[ca] == ta, common[cb] == tb) if len(common) else (np.zeros(len(ta), bool), np.zeros(len(tb), bool))
    ca, ra, cb, rb = ca[oka], ra[oka], cb[okb], rb[okb]
    for lo in range(0, len(common), columns):
        hi = min(lo + columns, len(common))
        x, y = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        m = (ca >= lo) & (ca < hi)
        x[ra[m], ca[m] - lo] = 1
        m = (cb >= lo) & (cb < hi)
        y[rb[m], cb[m] - lo] = 1
        out += x @ y.T
    return out


Item = tuple[np.ndarray, np.ndarray]  # a set, and its prefix under the first order


def links(a: list[Item], b: list[Item], percent: int = PERCENT, orders: int = ORDERS) -> np.ndarray:
    """Which of a link with which of b: filtered by size and under each order, then verified."""
    na, nb = np.array([len(x) for x, _ in a])[:, None], np.array([len(x) for x, _ in b])[None, :]
    able = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    able &= _counts([p for _, p in a], [p for _, p in b]) > 0
    for k in range(1, orders):
        if not able.any():
            return able
        able &= _counts([prefix(x, k, percent) for x, _ in a], [prefix(x, k, percent) for x, _ in b]) > 0
    i, j = np.nonzero(able)
    if len(i) > 4:
        both = _counts([x for x, _ in a], [x for x, _ in b])[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(a[x][0], b[y][0], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    able[i, j] = 100 * both >= percent * (na[i, 0] + nb[0, j] - both)
    return able


def _block(rows: list[tuple], percent: int, orders: int) -> Iterator[tuple[int, int | None, int]]:
    """Of one block, rows (chunk, cid, copies, item): edges (u, v, 0) of a spanning forest, and (u, null, documents linked)."""
    chunk = sorted({r[0] for r in rows})
    a = [r for r in rows if r[0] == chunk[0]]
    b = [r for r in rows if r[0] == chunk[-1]] if len(chunk) > 1 else a
    found = links([r[3] for r in a], [r[3] for r in b], percent, orders)
    if a is b:
        np.fill_diagonal(found, False)
    ca, cb = np.array([r[2] for r in a]), np.array([r[2] for r in b])
    for r, n in [*zip(a, (found @ cb).tolist(), strict=True), *([] if a is b else zip(b, (ca @ found).tolist(), strict=True))]:
        if n:
            yield r[1], None, n
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for i, j in zip(*np.nonzero(found), strict=True):
        u, v = find(a[i][1]), find(b[j][1])
        if u != v:
            root[max(u, v)] = min(u, v)
            yield a[i][1], b[j][1], 0


def _verified(blocks: DataFrame, percent: int, orders: int) -> DataFrame:
    """blocks: of _placed, sorted by block within partitions. Chunks of a cluster's diagonal block have one chunk only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: dict) -> Iterator[pa.RecordBatch]:
            rows = list(held.values())
            if now[1] != now[2] and len({r[0] for r in rows}) < 2:
                return  # the other chunk is empty
            if len(rows) > 1 and (got := list(_block(rows, percent, orders))):
                u, v, n = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, n)], ["u", "v", "n"])

        now, held = None, {}
        for b in batches:
            for c, i, j, chunk, cid, copies, s, p in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (c, i, j) != now:
                    if now:
                        yield from out(held)
                    now, held = (c, i, j), {}
                held[cid, s] = (chunk, cid, copies, (np.frombuffer(s, np.uint64), np.frombuffer(p, np.uint64)))
        if now:
            yield from out(held)

    return blocks.mapInArrow(released(run), "u long, v long, n long")


_PLACED = "c long, bi int, bj int, chunk int, cid long, copies long, s binary, p binary"


def _placed(docs: DataFrame, words: int) -> DataFrame:
    """docs: text with its class (k1, k2, cid, copies, p), cluster c and that one's chunks. The set and its prefix for each block that needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.select(["k1", "k2", "cid", "copies", "p", "c", "chunks"]).to_pylist()
            rows, size = [], 0
            for i, s in _each(b, words):
                r = known[i]
                if _key(s) != (r["k1"], r["k2"]):
                    continue  # another text of the same doc_id
                own, s_ = (r["cid"] ^ r["k2"]) % r["chunks"], s.tobytes()
                for o in range(r["chunks"]):
                    rows.append((r["c"], min(own, o), max(own, o), own, r["cid"], r["copies"], s_, r["p"]))
                    size += len(s_)
                    if size > 8_000_000:
                        yield _batch(_PLACED, rows)
                        rows, size = [], 0
            if rows:
                yield _batch(_PLACED, rows)

    return docs.select("text", "k1", "k2", "cid", "copies", "p", "c", "chunks").mapInArrow(released(run), _PLACED)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """docs: doc_id, text. A row for each: doc_id, n_shingles, component_id, n_links (documents it links with)."""
    spark = docs.sparkSession
    scan = stored(_scan(docs, words), "sets")
    rows = scan.where("n IS NOT NULL").select("doc_id", "n", "k1", "k2")
    top = scan.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    token, count = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    by = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[by], count[by]))
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = min(max(-(-total // BUCKET) - 1, 63).bit_length(), 24)
    classes = stored(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "classes")

    found = stored(prefixes(docs, words, percent, frequent, bits), "prefixes")
    # Clusters go by k1 alone: were two sets to share it, their clusters would be one, which costs time and changes nothing.
    # As stored tables these are shuffled for the join by themselves, which lets adaptive execution split a hot token.
    postings = stored(_postings(found), "postings")
    shared = stored(postings.groupBy("token").agg(F.min("k1").alias("u"), F.max("k1").alias("v")).where("u < v").select("token", "u"), "shared")
    bound = postings.join(shared, "token").where("k1 <> u").select("u", F.col("k1").alias("v")).distinct()
    cluster = components(bound)
    own = cluster.join(classes.where("cid IS NOT NULL"), cluster.node == classes.k1).join(found, ["k1", "k2"])
    member = stored(own.select(F.col("root").alias("c"), "k1", "k2", "cid", "copies", "p", F.greatest("n", F.lit(LIGHT)).alias("weight")), "members")
    discard(found, postings, shared)
    size = member.groupBy("c").agg(F.sum("weight").alias("all"))
    size = size.select("c", F.ceil(F.col("all") / F.least(F.greatest(F.col("all") / SIDES, F.lit(SMALL)), F.lit(BLOCK))).cast("int").alias("chunks"))
    weighed, member = member, stored(member.join(stored(size, "clusters"), "c").drop("weight").withColumnRenamed("cid", "doc_id"), "members")
    discard(weighed)
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    # never a broadcast: the join keeps the two Python steps around it in different stages, so that a task has one worker
    suspects = thinned(whole, member, "doc_id").join(member.hint("merge"), "doc_id").withColumnRenamed("doc_id", "cid")
    blocks = _placed(suspects, words)
    found = stored(_verified(blocks.repartition("c", "bi", "bj").sortWithinPartitions("c", "bi", "bj"), percent, orders), "links")

    linked = components(found.where("v IS NOT NULL").select("u", "v"))
    degree = found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("linked"))
    of = linked.join(degree, "node", "left")
    known = classes.join(of, classes.cid == of.node, "left").select("k1", "k2", F.coalesce("root", "cid").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = stored(known, "components")
    discard(member, found, classes)
    return rows.join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, percent: int = 80) -> DataFrame:
    """Keeps one document of each group, that of least doc_id (null last), with all its columns, whatever the names.
    Defined cases: as above, but rows with null or repeated doc_id are documents of their own; rows without words stay."""
    # columns go by position, so that any names do
    names = docs.columns
    docs = docs.toDF(*(c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(names)))
    own = F.col("doc_id").cast("long")
    again = stored(docs.groupBy(own.alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        found = jaccard_components(docs.select("doc_id", "text"), words, percent)
        gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "copies")
        return docs.join(gone, own == F.col("gone"), "left_anti").toDF(*names)
    # such rows are numbered and stored, as a number must not change when a task is repeated
    shared = again.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "again")
    loose = docs.join(shared, own == F.col("again"), "left_semi").unionByName(docs.where("doc_id IS NULL"))
    loose = stored(loose.withColumn("row", F.xxhash64(F.lit("row"), F.monotonically_increasing_id())), "loose")
    rows = docs.where("doc_id IS NOT NULL").join(shared, own == F.col("again"), "left_anti").withColumn("row", own).unionByName(loose)
    found = jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("row"), "component_id")
    real = loose.select("row", own.alias("id"), F.lit(True).alias("loose"))
    found = found.join(real, "row", "left").select("row", "component_id", F.when(F.col("loose"), F.col("id")).otherwise(F.col("row")).alias("id"))
    found = stored(found, "groups")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = stored(found.join(best.select("component_id", F.col("best.row").alias("kept")), "component_id").where("row <> kept").select(F.col("row").alias("gone")), "copies")
    return rows.join(gone, F.col("row") == F.col("gone"), "left_anti").drop("row").toDF(*names)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {WORDS}) - 1], ' ') AS s FROM
    (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), {WORDS}) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id)
    JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
least_ AS (SELECT x, min(y) AS c FROM r GROUP BY x),
l AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least_.c AS component_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM d JOIN least_ ON least_.x = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.x = d.doc_id"""

SQL = {"op4_jaccard_join": _SQL}
