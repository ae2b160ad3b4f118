"""Conversation prefix trie: succinct level-order (LOUDS) tries per prefix shard, rollups in reverse breadth-first order.

Method: a turn is a digest; a prefix is named by 128 bits, sums of hashes of its turns and their places, so that names
come from a running sum and no task walks a whole conversation. Conversations with the same turns are one path with a
number of members. Paths are cut into bands of BAND levels. In a band, nodes that more than HEAVY paths pass are the heavy
upper levels; below them every path belongs to the shard of its first other node, so a shard is bounded by both
constants. Tasks build one LOUDS bitvector with its label arrays for a forest of whole shards, level by level in numpy, and
roll leaves and savings up from the last level to the first with add.at. What shards hold is then merged into the heavy
nodes above them by grouped sums, and what lower bands hold is carried into the nodes where upper ones end: each shard's
sums belong to its least conversation, whose suffix sums by band are added up for each such node.

Savings: a node that n conversations share saves its last text n - 1 times. Hot conversations, first turns and copies are
sums before any shuffle; the ids of members of a path are hashed as a stream of parts in order.

Defined cases: null role or text is empty. Rows without conv_id belong to no conversation. Turns of a conversation are
ordered by number, null first, and turns of equal number by their content's digest; repeated rows are turns of their own.
Texts of any length are read whole, in the JVM. An empty table has no root and gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import heavy_keys, scanned
from .common import released, settled, stored, table

#: Levels of a band, and paths through a node beyond which it is a heavy one: what a shard holds at most.
BAND, HEAVY = 64, 128
#: Turns that a task gathers before it builds a trie, about.
FOREST = 1 << 17
#: Members of a path whose ids are joined by one aggregate; ids in a part of a longer stream.
MEMBERS, STREAM = 10_000, 1 << 16

#: The rebuild of the query: conversations of a block of so many ids begin with turns of its first one.
BLOCK = 20
NOTHING = hashlib.sha256(b"").hexdigest()


# --- turns ------------------------------------------------------------------------------------------------------


def placed_turns(conversations: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """conv_id, place (from 0), digest, words of each turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))
    return scanned(rows, ["conv_id"], ["turn", "digest"], place="place", heavy=heavy).select("conv_id", "place", "digest", "words")


def shared_heads(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, place, digest, words), and every conv_id: a conversation begins with the first h turns of
    the first one of its block, then come its own after its first h; h is the crc32 of its id modulo 4."""
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = placed.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < 3))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int").alias("h"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice("head", F.lit(1), F.col("h")))
    convs = stored(convs.withColumn("shift", F.col("h") - F.coalesce(F.size("head"), F.lit(0))).select("conv_id", "h", "shift", "head"), "conversations")
    own = placed.join(convs.select("conv_id", "h", "shift"), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("shift")).alias("place"), "digest", "words")
    first = convs.select("conv_id", F.inline("head")).select("conv_id", F.col("place").cast("long").alias("place"), "digest", "words")
    return own.unionByName(first), convs.select("conv_id")


def banded(turns: DataFrame, heavy: DataFrame | None, band: int) -> DataFrame:
    """turns named by their prefixes and cut into bands: conv_id, band, root (the prefix before it, null in the first), turns."""
    parts, low = {}, F.lit(0xFFFFFFFF).cast("long")
    for k in (1, 2):  # sums of 32 bits can't overflow, and name a prefix modulo 2^32
        h = F.xxhash64(F.lit(k), F.col("place"), F.col("digest"))
        parts |= {f"s{k}": F.shiftrightunsigned(h, 32), f"t{k}": h.bitwiseAND(low)}
    rows = scanned(turns.select("conv_id", "place", F.xxhash64("digest").alias("label"), "words", *(c.alias(f"own_{n}") for n, c in parts.items())), ["conv_id"], ["place"], sums={n: f"own_{n}" for n in parts}, heavy=heavy)

    def named(less: bool) -> Column:
        value = lambda n: (F.col(n) - F.col(f"own_{n}") if less else F.col(n)).bitwiseAND(low)
        return F.struct(*(F.shiftleft(value(f"s{k}"), 32).bitwiseOR(value(f"t{k}")).alias(c) for k, c in ((1, "a"), (2, "b"))))

    rows = rows.select("conv_id", "place", (F.col("place") / band).cast("long").alias("band"), named(True).alias("prefix"), named(False).alias("id"), "label", "words")
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("id.a").alias("a"), F.col("id.b").alias("b"), "label", "words"))).alias("turns")
    by = rows.groupBy("conv_id", "band").agg(listed, F.min_by("prefix", "place").alias("prefix"))
    return by.select("conv_id", "band", F.when(F.col("band") > 0, F.col("prefix")).alias("root"), "turns")


# --- members ----------------------------------------------------------------------------------------------------


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, conv_id in order: the ids of each prefix joined, in parts of STREAM."""
    for batch in batches:
        a, b, conv = (c.to_numpy() for c in batch.columns)
        cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
        at = [(k, min(k + STREAM, z)) for i, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) for k in range(i, z, STREAM)]
        if at:
            first = [i for i, _ in at]
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(conv[first]), pa.array([",".join(map(str, conv[i:z].tolist())) for i, z in at])], ["a", "b", "conv_id", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of streams in order: the SHA-256 of each, holding one part at a time."""
    now, sha = None, None
    done = lambda: pa.RecordBatch.from_pydict({"a": [now[0]], "b": [now[1]], "sha": [sha.hexdigest()]}, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())]))
    for batch in batches:
        for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids")), strict=True):
            if (a, b) != now:
                if now is not None:
                    yield done()
                now, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if now is not None:
        yield done()


def end_groups(ends: DataFrame, most: int = MEMBERS) -> DataFrame:
    """ends: conv_id and the name (a, b) of all its turns. Per name: least conv_id, members, sha of the ascending ids.

    Names of more than most members are hashed as streams: range parts join their ids, and one task reads the parts of a
    name in order, STREAM ids in a row."""
    sizes = stored(ends.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members")), "ends")
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").cast("binary"), 256)
    single = sizes.where("members = 1").withColumn("sha", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    few, many = (sizes.where(c) for c in (f"members > 1 AND members <= {most}", f"members > {most}"))
    shas = ends.join(few.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(joined.alias("sha"))
    out = single.unionByName(few.join(shas, ["a", "b"]))
    if many.isEmpty():
        return out.select("conv_id", "members", "sha", "a", "b")
    rows = ends.join(F.broadcast(many.select("a", "b")), ["a", "b"], "left_semi") if most >= MEMBERS else ends.join(many.select("a", "b"), ["a", "b"], "left_semi")
    parts = stored(rows.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_streamed, "a long, b long, conv_id long, ids string"), "ids")
    streams = parts.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_digested, "a long, b long, sha string")
    return out.unionByName(many.join(streams, ["a", "b"])).select("conv_id", "members", "sha", "a", "b")


# --- LOUDS ------------------------------------------------------------------------------------------------------


class Louds:
    """A trie in level order: for each node a one for each child, then a zero. Node 0 is the root; labels[k - 1] leads to node k."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        ones = np.flatnonzero(bits)
        #: Of node k + 1: the number of zeros before its one.
        self.parents = ones - np.arange(len(ones))
        zeros = np.flatnonzero(~bits)
        self.children = np.diff(zeros, prepend=-1) - 1

    @classmethod
    def of(cls, parents: np.ndarray, labels: np.ndarray) -> Louds:
        """parents: of the nodes 1, 2, .. in level order."""
        counts = np.bincount(parents, minlength=len(parents) + 1)
        bits = np.ones(2 * len(parents) + 1, bool)
        bits[np.cumsum(counts) + np.arange(len(counts))] = False
        return cls(bits, labels)

    @classmethod
    def packed(cls, bits: bytes, labels: bytes) -> Louds:
        labels = np.frombuffer(labels, np.int64)
        return cls(np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * len(labels) + 1).astype(bool), labels)

    def pack(self) -> tuple[bytes, bytes]:
        return np.packbits(self.bits).tobytes(), self.labels.astype(np.int64).tobytes()

    def levels(self) -> list[tuple[int, int]]:
        """(first node, end) of each level, from that of the root."""
        first = np.cumsum(self.children) - self.children + 1  # of each node: its first child
        out, a, z = [], 0, 1
        while a < z:
            out.append((a, z))
            a, z = z, int(first[z - 1] + self.children[z - 1])
        return out

    def rolled(self, own: np.ndarray) -> np.ndarray:
        """own, and all that lies below each node: levels from the last to the first add to their parents."""
        out = own.copy()
        for a, z in reversed(self.levels()[1:]):
            np.add.at(out, self.parents[a - 1 : z - 1], out[a:z])
        return out


def build(start: np.ndarray, lens: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The trie of paths given by names and labels of their turns: start and lens of each path in a, b, label.

    Gives the trie, of each node but the root the index of its turn and of a path through it, and for each level the
    paths through it with their nodes, in order of the nodes."""
    node = np.zeros(len(lens), np.int64)
    parents, turns, paths, through, nodes, level = [], [], [], [], 1, 0
    while len(on := np.flatnonzero(lens > level)):
        at = start[on] + level
        order = np.lexsort((b[at], a[at], label[at], node[on]))
        on, at = on[order], at[order]
        new = np.concatenate(([True], (a[at[1:]] != a[at[:-1]]) | (b[at[1:]] != b[at[:-1]])))
        parents.append(node[on[new]])
        node[on] = nodes + np.cumsum(new) - 1
        turns.append(at[new])
        paths.append(on[new])
        through.append((on, node[on]))
        nodes += int(new.sum())
        level += 1
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Louds.of(join(parents), label[join(turns)]), join(turns), join(paths), through


# --- rollups ----------------------------------------------------------------------------------------------------

_ID = "struct<a long, b long>"
_NODES = f"conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id {_ID}, parent {_ID}, above array<{_ID}>"
_TRIES = "n_nodes long, bits binary, labels binary"


def _long(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(t.column(name), 0).to_numpy().astype(np.int64)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    return np.cumsum(lens) - lens, lens, {n: values.field(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "label", "words")}


def _forest(t: pa.Table) -> tuple[Louds, pa.RecordBatch]:
    """The trie of whole shards, and its nodes."""
    start, lens, turn = _flat(t.column("turns"))
    conv, members, base = _long(t, "conv_id"), _long(t, "members"), _long(t, "base")
    trie, at, path, through = build(start, lens, turn["a"], turn["b"], turn["label"])
    n = len(at) + 1
    n_convs, least, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    full, ends = np.zeros(n, bool), pc.is_valid(t.column("sha")).to_numpy()
    more = {c: (_long(t, f"more_{c}"), np.zeros(n, np.int64)) for c in ("children", "leaves", "saved")}
    depth = np.zeros(n, np.int64)
    for level, (on, node) in enumerate(through):
        cut = np.flatnonzero(np.diff(node, prepend=-1))
        n_convs[node[cut]], least[node[cut]] = np.add.reduceat(members[on], cut), np.minimum.reduceat(conv[on], cut)
        depth[node[cut]] = base[on[cut]] + level + 1
        last = lens[on] == level + 1
        end[node[last]] = on[last]
        whole = last & ends[on]  # of paths that the band cuts at a node, one at most ends there
        end[node[whole]] = on[whole]
        full[node[last]] = True
        for given, carried in more.values():  # what lies below a band's last level
            np.maximum.at(carried, node[last], given[on[last]])
    children = trie.children + more["children"][1]
    leaves = trie.rolled(np.where(children == 0, 1, more["leaves"][1]))
    saved = np.zeros(n, np.int64)
    saved[1:] = (n_convs[1:] - 1) * turn["words"][at]
    saved = trie.rolled(saved + more["saved"][1])
    top = np.concatenate(([False], trie.parents == 0))
    keep = np.arange(1, n)
    sha = t.column("sha").take(pa.array(np.where(full, end, 0)[1:])).combine_chunks()
    sha = pc.fill_null(pc.if_else(pa.array(full[1:]), sha, pa.scalar(None, pa.string())), NOTHING)
    ids = pa.StructArray.from_arrays([pa.array(turn["a"][at]), pa.array(turn["b"][at])], ["a", "b"], mask=pa.array(~(top | full)[1:]))
    out = [pa.array(least[keep]), pa.array(depth[keep]), pa.array(least[trie.parents], mask=top[1:]), pa.array(n_convs[keep]), pa.array(children[keep]), pa.array(leaves[keep]), pa.array(saved[keep]), sha, ids]
    first = pa.array(np.where(top[1:], path, 0), mask=~top[1:])
    out += [t.column(c).take(first).combine_chunks() for c in ("parent", "above")]
    return trie, pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out], ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "id", "parent", "above"])


def _forests(made):
    """A function on batches of paths in order of their shards: made(trie, nodes) for each gathered forest of whole shards."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += len(batch.column("turns").flatten())
            if n >= FOREST:
                t = pa.Table.from_batches(held)
                key = t.column("shard").combine_chunks()
                key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
                a, b = (key.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                cut = int(np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[-1])  # where the last shard begins
                if cut:
                    yield made(*_forest(t.slice(0, cut)))
                held = t.slice(cut).combine_chunks().to_batches()
                n = sum(len(x.column("turns").flatten()) for x in held)
        if held:
            yield made(*_forest(pa.Table.from_batches(held)))

    return run


def _packed(trie: Louds, nodes: pa.RecordBatch) -> pa.RecordBatch:
    bits, labels = trie.pack()
    return pa.RecordBatch.from_arrays([pa.array([len(trie.labels)], pa.int64()), pa.array([bits], pa.binary()), pa.array([labels], pa.binary())], ["n_nodes", "bits", "labels"])


def _cut(paths: DataFrame, band: int, heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """paths with upper: how many of their first nodes are heavy; and the paths' heavy nodes: conv_id, band, pos, id, next."""
    nodes = paths.select("conv_id", "band", F.posexplode("turns").alias("pos", "x")).select("conv_id", "band", "pos", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    found = stored(nodes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).drop("n"), "heavy-nodes")
    if found.isEmpty():
        return paths.withColumn("upper", F.lit(0)), None
    passed = stored(nodes.join(found, ["a", "b"], "left_semi"), "heavy-passed")
    upper = passed.groupBy("conv_id", "band").agg(F.count(F.lit(1)).cast("int").alias("upper"))
    return stored(paths.join(upper, ["conv_id", "band"], "left").withColumn("upper", F.coalesce("upper", F.lit(0))), "paths"), passed


def _names(column: str, n: Column) -> Column:
    return F.transform(F.slice(column, F.lit(1), n), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))


def _sharded(paths: DataFrame, band: int) -> DataFrame:
    """What is below the heavy nodes, dealt and ordered by shard."""
    rows = paths.where(F.col("upper") < F.size("turns")).withColumn("above", _names("turns", F.col("upper")))
    first = F.element_at("turns", F.col("upper") + 1)
    rows = rows.select(
        F.struct(first["a"].alias("a"), first["b"].alias("b")).alias("shard"), "conv_id", "members", "sha", (F.col("band") * band + F.col("upper")).alias("base"),
        F.when(F.col("upper") > 0, F.element_at("above", -1)).otherwise(F.col("root")).alias("parent"), "above",
        F.transform(F.slice("turns", F.col("upper") + 1, F.lit(band)), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["label"].alias("label"), x["words"].alias("words"))).alias("turns"),
        "more_children", "more_leaves", "more_saved",
    )
    return rows.repartition("shard").sortWithinPartitions("shard")


def rollup(paths: DataFrame, band: int, heavy: int) -> DataFrame:
    """The nodes of paths, by shards and by heavy nodes above them; parent_conv_id is null where the parent is outside of the shard."""
    paths, passed = _cut(paths, band, heavy)
    nodes = stored(_sharded(paths, band).mapInArrow(_forests(lambda _, nodes: nodes), _NODES), "nodes")
    if passed is None:
        return nodes
    at = passed.join(paths, ["conv_id", "band"]).select("*", F.element_at("turns", F.col("pos") + 1).alias("here"), (F.col("pos") + 1 == F.size("turns")).alias("last"))
    next_ = F.when(~F.col("last"), F.struct(F.expr("turns[pos + 1].a").alias("a"), F.expr("turns[pos + 1].b").alias("b")))
    over = lambda c: F.max(F.when(F.col("last"), F.col(c)))
    # a row for each child first, so that no set of children is held
    by_child = at.groupBy("a", "b", next_.alias("next")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.first(F.col("band") * band + F.col("pos") + 1).alias("depth"), F.first("here.words").alias("words"), over("sha").alias("sha"),
        F.first(F.when(F.col("pos") > 0, F.struct(F.expr("turns[pos - 1].a").alias("a"), F.expr("turns[pos - 1].b").alias("b"))).otherwise(F.col("root"))).alias("parent"), F.first(_names("turns", F.col("pos") + 1)).alias("above"),
        *(over(f"more_{c}").alias(f"more_{c}") for c in ("children", "leaves", "saved")),
    )
    most = lambda c: F.coalesce(F.max(f"more_{c}"), F.lit(0)).alias(f"more_{c}")
    top = by_child.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.max("sha").alias("sha"), F.count("next").alias("n_children"), F.first("parent").alias("parent"), F.first("above").alias("above"),
        *(most(c) for c in ("children", "leaves", "saved")),
    )
    top = stored(top, "heavy-nodes")
    sums = nodes.where(F.size("above") > 0).select("above", "n_leaves", "saved_tokens").unionByName(top.select("above", F.col("more_leaves").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.col("more_saved")).alias("saved_tokens")))
    sums = sums.select(F.explode("above").alias("x"), "n_leaves", "saved_tokens").groupBy(F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = top.join(sums, ["a", "b"]).select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", (F.col("n_children") + F.col("more_children")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"),
        F.struct("a", "b").alias("id"), "parent", F.slice("above", F.lit(1), F.size("above") - 1).alias("above"),
    )
    return nodes.unionByName(stored(top, "heavy-rolled"))


def _carried(paths: DataFrame, heavy_convs: DataFrame | None, band: int, heavy: int) -> DataFrame:
    """a, b (a node where a band ends), and the children, leaves and savings below it."""
    lower = paths.where("band > 0")
    zero = F.lit(0).cast("long")
    goes_on = F.when(F.col("sha").isNull(), F.lit(1).cast("long")).otherwise(zero)  # so that the end of a band is no leaf
    tops = rollup(lower.select("*", goes_on.alias("more_children"), zero.alias("more_leaves"), zero.alias("more_saved")), band, heavy).where(F.col("depth") % band == 1 if band > 1 else F.lit(True))
    # a top's sums belong to its least conversation, which has one top a band
    owned = tops.select("conv_id", ((F.col("depth") - 1) / band).cast("long").alias("band"), "n_leaves", "saved_tokens")
    rows = lower.select("conv_id", "band", "root", F.expr("struct(turns[0].a AS a, turns[0].b AS b)").alias("top")).join(owned, ["conv_id", "band"], "left")
    rows = rows.select("conv_id", (-F.col("band")).alias("back"), "root", "top", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")))
    rows = scanned(rows, ["conv_id"], ["back"], sums={"leaves": "n_leaves", "saved": "saved_tokens"}, heavy=heavy_convs)
    by_top = rows.groupBy("root", "top").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    out = by_top.groupBy("root").agg(F.count(F.lit(1)).alias("more_children"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    return stored(out.select("root.a", "root.b", "more_children", "more_leaves", "more_saved"), "carried")


def conversation_paths(conversations: DataFrame, rebuild: bool = False, band: int = BAND, rows: int | None = None, members: int = MEMBERS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The distinct conversations in bands (conv_id: the least member, band, root, turns, members and sha at the last band,
    what is carried), every distinct sequence (conv_id, members, sha, and a = b = 0 if it has no turns), and large conversations."""
    named = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"))
    heavy = heavy_keys(named, ["conv_id"], rows) if rows else heavy_keys(named, ["conv_id"])
    turns = placed = stored(placed_turns(conversations, heavy), "turns")
    convs = None
    if rebuild:
        turns, convs = shared_heads(placed)
    bands = stored(banded(turns, heavy, band), "bands")
    end = bands.select("conv_id", F.struct("band", F.element_at("turns", -1).alias("x")).alias("x")).groupBy("conv_id").agg(F.max("x").alias("x")).select("conv_id", F.col("x.x.a").alias("a"), F.col("x.x.b").alias("b"), F.col("x.band").alias("last"))
    if convs is not None:
        zero = F.lit(0).cast("long")
        end = convs.join(end, "conv_id", "left").select("conv_id", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), "last")
    end = stored(end, "ends")
    groups = stored(end_groups(end.select("conv_id", "a", "b"), members), "sequences")
    kept = groups.join(end.select("conv_id", "last"), "conv_id")
    paths = bands.join(kept.select("conv_id", "members", "sha", "last"), "conv_id").withColumn("sha", F.when(F.col("band") == F.col("last"), F.col("sha"))).drop("last")
    return stored(paths, "paths"), groups, heavy


def trie_nodes(conversations: DataFrame, rebuild: bool = False, band: int = BAND, heavy: int = HEAVY, rows: int | None = None, members: int = MEMBERS) -> DataFrame:
    """A row for each distinct prefix of the conversations, the empty one included: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths, groups, large = conversation_paths(conversations, rebuild, band, rows, members)
    carried = None
    if paths.where("band > 0").isEmpty():
        paths = paths.select("*", *(F.lit(0).cast("long").alias(f"more_{c}") for c in ("children", "leaves", "saved")))
    else:
        carried = _carried(paths, large, band, heavy)
        full = paths.withColumn("a", F.when(F.size("turns") == band, F.element_at("turns", -1)["a"])).withColumn("b", F.element_at("turns", -1)["b"])
        paths = stored(full.join(carried, ["a", "b"], "left").drop("a", "b").na.fill(0, [f"more_{c}" for c in ("children", "leaves", "saved")]), "carried-paths")
    nodes = rollup(paths, band, heavy)
    least = F.struct("conv_id", "members")
    whole = groups.agg(F.min(least)["conv_id"].alias("conv_id"), F.sum("members").alias("n_convs"), F.max(F.when((F.col("a") == 0) & (F.col("b") == 0), F.col("sha"))).alias("sha")).where("n_convs > 0")
    first = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    root = stored(whole.join(F.broadcast(first)), "root").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"),
    )
    names = root.columns
    inner = nodes.where("parent_conv_id IS NOT NULL").select(names)
    low = nodes.where("depth = 1").drop("parent_conv_id").join(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id")))).select(names)
    # parents outside of the shard are heavy, or the last of a band
    outer = nodes.where("parent_conv_id IS NULL AND depth > 1").drop("parent_conv_id")
    known = nodes.where("id IS NOT NULL").select(F.col("id.a").alias("a"), F.col("id.b").alias("b"), F.col("conv_id").alias("parent_conv_id"))
    outer = outer.withColumns({"a": F.col("parent.a"), "b": F.col("parent.b")}).join(known, ["a", "b"]).select(names)
    return inner.unionByName(low).unionByName(outer).unionByName(root)


def packed_tries(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The tries themselves, a row for each forest of whole shards: n_nodes, bits (LOUDS) and labels, for Louds.packed()."""
    paths, _, _ = conversation_paths(conversations)
    paths, _ = _cut(paths.select("*", *(F.lit(0).cast("long").alias(f"more_{c}") for c in ("children", "leaves", "saved"))), BAND, heavy)
    return _sharded(paths, BAND).mapInArrow(_forests(_packed), _TRIES)


@settled
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), rebuild=True)


def _sql() -> str:
    """Prefixes as lists of lengths, roles and texts; savings by joining each conversation's nodes with each other."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"
    return rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS base, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.place AS k, role, text FROM c JOIN t ON t.conv_id = c.base AND t.place < h
    UNION ALL SELECT t.conv_id, t.place + 1000000000, role, text FROM t JOIN c USING (conv_id) WHERE place >= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS id, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS (SELECT conv_id, depth, id, words FROM p UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS length FROM m GROUP BY conv_id),
u AS (SELECT m.*, lag(id) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, length FROM m JOIN l USING (conv_id)),
n AS (SELECT id, any_value(depth) AS depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) * (count(*) - 1) AS saved, bool_and(depth = length) AS leaf,
    sha256(coalesce(string_agg(CASE WHEN depth = length THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM u GROUP BY id),
k AS (SELECT parent AS id, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
b AS (SELECT a.id, sum(n.saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM (SELECT DISTINCT x.id, y.id AS below FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.depth <= y.depth) a JOIN n ON n.id = a.below GROUP BY a.id)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n q ON q.id = n.parent LEFT JOIN k ON k.id = n.id JOIN b ON b.id = n.id"""


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
SQL = {"op13_prefix_trie": _sql()}
