"""One-to-one matching of extracted records with gold records, by similarity of their normalised fields.

All functions take key columns (a run, a page, ...): records only match within equal keys, so many runs are one job.
Candidates come from an equi-join on keys of several rare characters of the headwords (sound for the threshold), never
from a cross join. Records of a key with equal fields are one class: classes are compared and scored, and records stand
in for them only where pairs of records are asked for. The greedy assignment, gold records in order, each to its best free
candidate, is one pass over a key's records in order, with the pairs of its classes beside; a key of more than AT_ONCE such
rows is split by connected components of its classes or, where classes hold next to no more than one record, taken by pairs:
ROUNDS rounds first settle, all at once, the pairs which nothing that comes earlier can touch, and what is left is taken in
order by connected components of the graph of pairs. Either way the result is exactly the sequential one."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pieces
from ..functions.similarity import TOGETHER, bag, edit_ratio, may_reach, ratio, with_keys, within_edits
from ..functions.text import normalize_text
from .components import components
from .scan import same_keys
from .storage import stored

HEAD = 0.7
#: Weights of headword, part of speech and translation.
WEIGHTS = (0.5, 0.15, 0.35)
PARTIAL = 0.85
#: Headwords of a key up to which candidates have one rare character in common, beyond several or a piece: a matter of the plan.
PAGE = 300
#: Rows (candidate pairs, or records and pairs of classes) of one key that one task takes in order, at most.
AT_ONCE = 1_000_000
#: Records of a class that are expanded together, about, and pairs that a task makes, about: a matter of the plan.
TOGETHER_AT_MOST, PAIRS_OF_A_TASK = 256, 1_000_000
#: Headwords whose keys a task makes, about, and bytes of keys that it makes at once; headwords of a key that are compared together, at most, and
#: pairs that a task compares, about: a matter of the plan.
HEADS_OF_A_TASK, KEYS_BYTES, TOGETHER_IN_BLOCK, COMPARED_BY_A_TASK = 50_000, 4 << 20, 4_096, 50_000_000
#: Pairs of records to a pair of classes up to which a large key is taken by pairs.
SPARSE = 4
#: Rounds of a large key before its pairs are split by components.
ROUNDS = 3
Similarity = Callable[[Column | str, Column | str], Column]
#: Field names of a record as matched.
HEADWORD, POS, TRANSLATION = "Headword_Phrase", "POS", "Translation_RU"
SCORES = ("head_score", "pos_score", "def_score", "overall")


def prepared(records: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """keys, the record's number ({side}_seq) and its normalised fields."""
    named = [normalize_text(c).alias(f"{side}_{n}") for c, n in ((HEADWORD, "head"), (POS, "pos"), (TRANSLATION, "def"))]
    return records.select(*keys, F.col("seq").alias(f"{side}_seq"), *named)


def similar_heads(gold: DataFrame, extracted: DataFrame, keys: Sequence[str] = (), threshold: float = HEAD, similarity: Similarity = ratio, page: int = PAGE) -> DataFrame:
    """Pairs of distinct headwords (g_head, e_head) with head_score of at least threshold.

    A single character tells enough apart on a page. Among more headwords it would be a hot key: then keys hold several, or for
    the edit ratio are pieces of the text with their places."""
    heads = [stored(df.select(*keys, f"{s}_head").distinct(), f"{s}-heads") for df, s in ((gold, "g"), (extracted, "e"))]
    large = not heads[0].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > page).isEmpty()
    if large and similarity is edit_ratio:
        met = _near_heads(*heads, keys, threshold).where(within_edits("g_head", "e_head", threshold))
    else:
        sides = [with_keys(df.withColumn(f"{s}_bag", bag(f"{s}_head")), f"{s}_bag", threshold, TOGETHER if large else ()) for df, s in zip(heads, "ge", strict=True)]
        # Spark takes the keys for as small as the headwords, and would broadcast them
        met = sides[0].hint("merge").join(sides[1], [*keys, "token"]).where(may_reach("g_bag", "e_bag", threshold)).select(*keys, "g_head", "e_head")
    met = stored(met.distinct(), "met")  # or the similarity would be computed for every key that two headwords have in common
    return _scored(met, "head", similarity).where(F.col("head_score") >= threshold)


def _piece_keys(heads: DataFrame, keys: Sequence[str], side: str, asked: Callable[[int], list]) -> DataFrame:
    """A row for each key (token) of a headword. asked: the keys of a text by its length."""
    head = f"{side}_head"
    out = heads.select(*keys, F.lit(0).cast("long").alias("token"), head).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            lengths = pc.utf8_length(b.column(head)).to_numpy(zero_copy_only=False)
            for n in map(int, np.unique(lengths)):
                of = known[n] if n in known else known.setdefault(n, asked(n))
                at, most = np.flatnonzero(lengths == n), max(KEYS_BYTES // (n + 16), 1)
                step = max(most // max(len(of), 1), 1)
                for k in range(0, len(at) if of else 0, step):
                    own = b.take(pa.array(at[k : k + step]))
                    codes, together = pieces.letters(own.column(head), n), max(most // own.num_rows, 1)
                    for j in range(0, len(of), together):
                        tokens = list(pieces.keys_of(codes, of[j : j + together]))
                        each = own.take(pa.array(np.tile(np.arange(own.num_rows), len(tokens))))
                        yield pa.RecordBatch.from_arrays([*(each.column(c) for c in keys), pa.array(np.concatenate(tokens)), each.column(head)], names=out.names)

    return heads.repartition(heads.count() // HEADS_OF_A_TASK + 1, *keys, head).mapInArrow(run, out)


def _blocks(keyed: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Headwords with a key in common as lists of bounded length ({side}_heads), with their size and a number that tells most blocks of a key apart."""
    columns = [F.array(f"{side}_head").alias(f"{side}_heads"), F.lit(0).cast("long").alias(f"{side}_size"), F.lit(0).cast("long").alias(f"{side}_at")]
    out = keyed.select(*keys, "token", *columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            if b.num_rows:
                other = np.ones(b.num_rows, bool)
                differ = [pc.fill_null(pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)), True).to_numpy(zero_copy_only=False) for c in (*keys, "token")]
                other[1:] = np.logical_or.reduce(differ)
                first = np.maximum.accumulate(np.where(other, np.arange(b.num_rows), 0))
                starts = np.flatnonzero((np.arange(b.num_rows) - first) % TOGETHER_IN_BLOCK == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, b.num_rows), pa.int32()), b.column(f"{side}_head"))
                own = b.select([*keys, "token"]).take(pa.array(starts))
                yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array(np.diff(starts, append=b.num_rows)), pa.array(starts + k * b.num_rows)], names=out.names)

    return keyed.repartition(*keys, "token").sortWithinPartitions(*keys, "token").mapInArrow(run, out)


def _near_heads(gold: DataFrame, extracted: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Pairs of headwords (keys, g_head, e_head) with a piece in common whose letters allow the threshold of the edit ratio; the same pair may come again.

    Extracted headwords are cut. Those with a key in common meet as blocks, and a task compares about as many pairs as any other."""
    gold, extracted = (df.dropna(subset=[*keys, f"{s}_head"]) for df, s in ((gold, "g"), (extracted, "e")))
    g_lengths, e_lengths = ([n for n, in df.select(F.length(f"{s}_head")).distinct().collect()] for df, s in ((gold, "g"), (extracted, "e")))
    keyed = (
        _piece_keys(gold, keys, "g", lambda n: pieces.asked_keys(n, e_lengths, g_lengths, threshold)),
        _piece_keys(extracted, keys, "e", lambda n: pieces.own_keys(n, g_lengths, threshold)),
    )
    g, e = (stored(_blocks(df, keys, s), f"{s}-blocks") for df, s in zip(keyed, "ge", strict=True))
    by = [*keys, "token"]
    total = g.select(*by, "g_size").hint("merge").join(e.select(*by, "e_size"), by).agg(F.sum(F.col("g_size") * F.col("e_size"))).first()[0] or 0
    out = gold.select(*keys, "g_head").join(extracted.select("e_head")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b.column(f"{s}_heads").flatten() for s in "ge"]
            for rows, p, q in pieces.near_pairs(b.column("g_heads"), b.column("e_heads"), threshold):
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in keys), texts[0].take(pa.array(p)), texts[1].take(pa.array(q))], names=out.names)

    # Spark takes the blocks for small, and would broadcast them
    met = g.hint("merge").join(e, by).repartition(total // COMPARED_BY_A_TASK + 1, "token", "g_at", "e_at")
    return met.select(*keys, "g_heads", "e_heads").mapInArrow(run, out)


def _scored(pairs: DataFrame, name: str, similarity: Similarity) -> DataFrame:
    """pairs with the similarity of g_{name} and e_{name}; other than the built-in one, once for each two texts."""
    g, e, score = f"g_{name}", f"e_{name}", f"{name}_score"
    if similarity is edit_ratio:
        return pairs.withColumn(score, similarity(g, e))
    texts = stored(pairs.select(g, e).distinct(), "texts")
    return pairs.join(stored(texts.withColumn(score, similarity(g, e)), "scores"), [g, e])


def _classes(records: DataFrame, keys: Sequence[str], side: str) -> tuple[DataFrame, DataFrame]:
    """Of prepared records the classes with their numbers ({side}_id) and sizes ({side}_n), and the records by them: keys, {side}_seq, {side}_id, {side}_n."""
    own = [*keys, *(f"{side}_{n}" for n in ("head", "pos", "def"))]
    classes = stored(records.groupBy(*own).agg(F.count(F.lit(1)).alias(f"{side}_n")).withColumn(f"{side}_id", F.monotonically_increasing_id()), "classes")
    return classes, stored(records.join(classes, own).select(*keys, f"{side}_seq", f"{side}_id", f"{side}_n"), "members")


def _class_pairs(gold: DataFrame, extracted: DataFrame, keys: Sequence[str], threshold: float, similarity: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of classes with similar headwords (keys, g_id, e_id, g_n, e_n and scores), and the records of both sides."""
    (g, gold_members), (e, extracted_members) = (_classes(prepared(df, keys, s), keys, s) for df, s in ((gold, "g"), (extracted, "e")))
    heads = stored(similar_heads(g, e, keys, threshold, similarity), "heads")
    pairs = heads.join(g, [*keys, "g_head"]).join(e, [*keys, "e_head"])
    if similarity is not edit_ratio:
        pairs = stored(pairs, "met-classes")
    pairs = _scored(_scored(pairs, "pos", similarity), "def", similarity)
    overall = F.lit(WEIGHTS[0]) * F.col("head_score") + F.lit(WEIGHTS[1]) * F.col("pos_score") + F.lit(WEIGHTS[2]) * F.col("def_score")
    return stored(pairs.select(*keys, "g_id", "e_id", "g_n", "e_n", *SCORES[:3], overall.alias("overall")), "class-pairs"), gold_members, extracted_members


def _expanded(pairs: DataFrame, gold_members: DataFrame, extracted_members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of classes as pairs of records. Members come in lists of bounded length, dealt so that each task makes about as many pairs."""
    total = pairs.agg(F.sum(F.col("g_n") * F.col("e_n"))).first()[0] or 0
    for df, s in ((gold_members, "g"), (extracted_members, "e")):
        part = F.pmod(F.xxhash64(f"{s}_seq"), F.ceil(F.col(f"{s}_n") / TOGETHER_AT_MOST)).alias(f"{s}_part")
        lists = stored(df.groupBy(f"{s}_id", part).agg(F.collect_list(f"{s}_seq").alias(f"{s}_seqs")), "lists")
        pairs = pairs.join(lists, f"{s}_id")
    dealt = pairs.repartition(total // PAIRS_OF_A_TASK + 1, "g_id", "e_id", "g_part", "e_part")
    each = dealt.select(*keys, F.explode("g_seqs").alias("g_seq"), "e_seqs", *SCORES)
    return each.select(*keys, "g_seq", F.explode("e_seqs").alias("e_seq"), *SCORES)


def candidate_pairs(gold: DataFrame, extracted: DataFrame, keys: Sequence[str] = (), threshold: float = HEAD, similarity: Similarity = ratio) -> DataFrame:
    """All pairs of records with similar headwords: keys, g_seq, e_seq, head_score, pos_score, def_score, overall."""
    return _expanded(*_class_pairs(gold, extracted, keys, threshold, similarity), keys)


def _in_order(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sequential assignment: a key's pairs in one task, by gold record, best first. The task holds the numbers that are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, record, taken = None, None, set()
        for b in batches:
            own = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * b.num_rows
            mask = []
            for key, g, e in zip(own, b.column("g_seq").to_pylist(), b.column("e_seq").to_pylist(), strict=True):
                if key != now:
                    now, record, taken = key, None, set()
                take = g != record and e not in taken
                if take:
                    record = g
                    taken.add(e)
                mask.append(take)
            yield b.filter(pa.array(mask, pa.bool_()))

    dealt = pairs.repartition(*keys) if keys else pairs.repartition(1)
    return dealt.sortWithinPartitions(*keys, "g_seq", F.desc("overall"), "e_seq").mapInArrow(run, pairs.schema)


def _settled(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of a record's best candidate that no earlier record could have: keys, g_seq, e_seq."""
    best = left.groupBy(*keys, "g_seq").agg(F.max(F.struct("overall", (-F.col("e_seq")).alias("o"))).alias("b")).select(*keys, "g_seq", (-F.col("b.o")).alias("e_seq"))
    first = left.groupBy(*keys, "e_seq").agg(F.min("g_seq").alias("g_seq"))
    return best.join(first, [*keys, "g_seq", "e_seq"])


def _by_components(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sequential assignment of each connected component by itself: no pair of one touches a pair of another.

    Records are named by hashes; two of one name would only make a component larger."""
    ends = [F.xxhash64(F.lit(s), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.col(f"{s}_seq")) for s in ("g", "e")]
    edges = stored(left.select("*", ends[0].alias("u"), ends[1].alias("v")), "named-pairs")
    roots = components(edges.select("u", "v")).withColumnRenamed("node", "u").withColumnRenamed("root", "component")
    return _in_order(edges.join(roots, "u").drop("u", "v"), [*keys, "component"]).drop("component")


def greedy_match(pairs: DataFrame, keys: Sequence[str] = (), at_once: int = AT_ONCE) -> DataFrame:
    """Of candidate pairs, those that the sequential greedy assignment takes. pairs should be stored: it is read several times."""
    left, found = pairs.where("overall > 0"), []
    for k in range(ROUNDS + 1):
        large = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > at_once).drop("n")
        if large.isEmpty():
            found.append(_in_order(left, keys))
            break
        if k == ROUNDS:
            large = stored(large, "large-keys") if keys else large
            found += [_in_order(same_keys(left, large, keys, "left_anti"), keys)] if keys else []
            found.append(_by_components(same_keys(left, large, keys, "left_semi") if keys else left, keys))
            break
        done = stored(_settled(left, keys), "settled")
        found.append(left.join(done, [*keys, "g_seq", "e_seq"]).select(pairs.columns))
        left = left.join(done.select(*keys, "g_seq"), [*keys, "g_seq"], "left_anti").join(done.select(*keys, "e_seq"), [*keys, "e_seq"], "left_anti")
        left = stored(left.select(pairs.columns), "left")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _records_in_order(pairs: DataFrame, gold_members: DataFrame, extracted_members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sequential assignment by classes: keys, g_seq, e_seq and scores.

    A key's rows come to one task as its extracted records in order, its pairs of classes, best first, and its gold records in
    order, which take what is free. The task holds the numbers of the extracted records and the pairs of classes."""
    none = [F.lit(None).cast("double").alias(c) for c in SCORES]
    records = lambda df, s, kind: df.select(*keys, F.lit(kind).alias("kind"), F.col(f"{s}_seq").cast("long").alias("place"), F.col(f"{s}_id").alias("own"), F.lit(None).cast("long").alias("other"), *none)
    between = pairs.where("overall > 0").select(*keys, F.lit(1).alias("kind"), F.col("g_id").alias("place"), F.col("g_id").alias("own"), F.col("e_id").alias("other"), *SCORES)
    rows = records(extracted_members, "e", 0).unionByName(between).unionByName(records(gold_members, "g", 2))
    kinds = [F.col(f"{s}_seq").cast(df.schema[f"{s}_seq"].dataType) for df, s in ((gold_members, "g"), (extracted_members, "e"))]
    out = rows.select(*keys, F.col("place").alias("g_seq"), F.col("place").alias("e_seq"), *SCORES).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, set()
        free: dict = {}  # of each extracted class its records' numbers, and how many of them are gone for certain
        after: dict = {}  # of each gold class its pairs: the other class and four scores for each
        gone: dict = {}  # of each gold class the pairs at its head whose class has no free record
        record, best = None, None

        def first(e) -> int | None:
            if (got := free.get(e)) is None:
                return None
            numbers, k = got
            while k < len(numbers) and numbers[k] in taken:
                k += 1
            got[1] = k
            return numbers[k] if k < len(numbers) else None

        def choice(g) -> tuple | None:
            """The best free candidate: (-overall, number, class, place among the pairs)."""
            if (listed := after.get(g)) is None:
                return None
            others, scores = listed
            k, found = gone.get(g, 0), None
            while k < len(others) and first(others[k]) is None:
                k += 1
            gone[g] = k
            overall = scores[4 * k + 3] if k < len(others) else None
            while k < len(others) and scores[4 * k + 3] == overall:
                if (e := first(others[k])) is not None and (found is None or e < found[1]):
                    found = (-overall, e, g, k)
                k += 1
            return found

        made: list = []

        def settle() -> None:
            if best is not None:
                taken.add(best[1])
                k = 4 * best[3]
                made.append((*now, record, best[1], *after[best[2]][1][k : k + 4]))

        for b in batches:
            own_keys = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * b.num_rows
            columns = [b.column(c).to_pylist() for c in ("kind", "place", "own", "other", *SCORES)]
            for key, kind, place, own, other, *scores in zip(own_keys, *columns, strict=True):
                if key != now:
                    settle()
                    now, taken, free, after, gone, record, best = key, set(), {}, {}, {}, None, None
                if kind == 0:
                    free.setdefault(own, [array("q"), 0])[0].append(place)
                elif kind == 1:
                    listed = after.setdefault(own, (array("q"), array("d")))
                    listed[0].append(other)
                    listed[1].extend(scores)
                else:
                    if place != record:
                        settle()
                        record, best = place, None
                    if (found := choice(own)) is not None and (best is None or found[:2] < best[:2]):
                        best = found
            kind_of_keys = [b.schema.field(k) for k in keys]
            if made:
                done, made = made, []
                yield batch(done, kind_of_keys)
        settle()
        if made:
            yield batch(made, kind_of_keys)

    def batch(done: list, kind_of_keys: list[pa.Field]) -> pa.RecordBatch:
        kinds = pa.schema([*kind_of_keys, ("g_seq", pa.int64()), ("e_seq", pa.int64()), *((c, pa.float64()) for c in SCORES)])
        return pa.RecordBatch.from_pydict(dict(zip(kinds.names, map(list, zip(*done, strict=True)), strict=True)), kinds)

    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    got = dealt.sortWithinPartitions(*keys, "kind", "place", F.desc("overall")).mapInArrow(run, out)
    return got.select(*keys, kinds[0], kinds[1], *SCORES)


def _greedy_by_classes(pairs: DataFrame, gold_members: DataFrame, extracted_members: DataFrame, keys: Sequence[str], at_once: int = AT_ONCE) -> DataFrame:
    """The sequential assignment of records by stored pairs of their classes: keys, g_seq, e_seq and scores."""
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("g_n") * F.col("e_n")).alias("pairs"))
    counts = [n] + [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("pairs")) for df in (gold_members, extracted_members)]
    sums = counts[0].union(counts[1]).union(counts[2]).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"))
    large = stored(sums.where(F.col("n") > at_once).withColumn("sparse", F.col("pairs") <= SPARSE * F.col("n")).drop("n", "pairs"), "large-keys")
    if large.isEmpty():
        return _records_in_order(pairs, gold_members, extracted_members, keys)
    tables, found = (pairs, gold_members, extracted_members), []
    if keys:
        found.append(_records_in_order(*(same_keys(df, large, keys, "left_anti") for df in tables), keys))
    of = lambda which: [same_keys(df, large.where(which).drop("sparse"), keys, "left_semi") for df in tables] if keys else tables
    if not large.where("sparse").isEmpty():
        found.append(greedy_match(stored(_expanded(*of("sparse"), keys), "pairs"), keys, at_once))
    if not large.where("NOT sparse").isEmpty():
        own, gold_own, extracted_own = of("NOT sparse")
        roots = stored(components(own.where("overall > 0").select((F.col("g_id") * 2).alias("u"), (F.col("e_id") * 2 + 1).alias("v"))).withColumnRenamed("root", "component"), "roots")
        named = lambda df, s, k: df.join(roots.select(F.col("node").alias("_node"), "component"), F.col(f"{s}_id") * 2 + k == F.col("_node")).drop("_node")
        split = _records_in_order(named(own, "g", 0), named(gold_own, "g", 0), named(extracted_own, "e", 1), [*keys, "component"])
        found.append(split.drop("component"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def classify(head: Column | str = "head_score", pos: Column | str = "pos_score", definition: Column | str = "def_score", overall: Column | str = "overall", partial: float = PARTIAL) -> Column:
    h, p, d, o = (F.col(x) if isinstance(x, str) else x for x in (head, pos, definition, overall))
    return F.when((h == 1.0) & (p >= 0.9) & (d >= 0.9), "exact").when(o >= partial, "partial").otherwise("below")


def match_records(gold: DataFrame, extracted: DataFrame, keys: Sequence[str] = (), partial: float = PARTIAL, similarity: Similarity = ratio) -> DataFrame:
    """The matched pairs with their scores and class."""
    found = _greedy_by_classes(*_class_pairs(gold, extracted, keys, HEAD, similarity), keys)
    return found.withColumn("match_class", classify(partial=partial))


def missing(gold: DataFrame, matches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gold records without a match."""
    return gold.join(matches.select(*keys, F.col("g_seq").alias("seq")), [*keys, "seq"], "left_anti").select(gold.columns)


def extra(extracted: DataFrame, matches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extracted records without a match."""
    return extracted.join(matches.select(*keys, F.col("e_seq").alias("seq")), [*keys, "seq"], "left_anti").select(extracted.columns)


def with_records(matches: DataFrame, gold: DataFrame, extracted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Matches with both records as structs, gold and extracted."""
    fields = [c for c in gold.columns if c not in (*keys, "seq")]
    g = gold.select(*keys, F.col("seq").alias("g_seq"), F.struct(*fields).alias("gold"))
    e = extracted.select(*keys, F.col("seq").alias("e_seq"), F.struct(*fields).alias("extracted"))
    return matches.join(g, [*keys, "g_seq"]).join(e, [*keys, "e_seq"])


def low_scores(matches: DataFrame, limit: int | None = None, below: float = 0.9) -> DataFrame:
    """Matches with an overall score below a limit, in gold order."""
    found = matches.where(F.col("overall") < below).orderBy("g_seq")
    return found.limit(limit) if limit is not None else found
