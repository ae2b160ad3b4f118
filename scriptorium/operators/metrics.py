"""Counts, rates and confusion tables of matched records. Every function takes key columns (a run, a page, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import WORD_OPS, char_distance, edit_ops, word_distance, word_ops
from ..functions.text import normalize_text, ratio_or_zero, strip, tokens
from ..schemas import COMPARED
from .scan import same_keys, scanned_by_parts
from .storage import stored

OPS = ("substitution", "deletion", "insertion")
#: Parts that the confusions of an op are dealt to for their ranks.
SALTS = 64
#: Confusions that are broadcast, at most.
FEW = 10_000


def _grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """A row per key; without keys one row, also of an empty table, with the constant _all to join by."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates).withColumn("_all", F.lit(0))


def match_counts(gold: DataFrame, extracted: DataFrame, matches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: counts, precision, recall, F1, and mean field scores over all matched pairs."""
    tally = lambda df, name: _grouped(df, keys, F.count(F.lit(1)).alias(name))
    scores = _grouped(
        matches, keys, F.count(F.lit(1)).alias("paired"), *(F.count_if(F.col("match_class") == c).alias(f"{c}_matches") for c in ("exact", "partial")),
        F.avg("head_score").alias("headword_accuracy"), F.avg("pos_score").alias("grammatical_accuracy"), F.avg("def_score").alias("definition_accuracy"),
    )
    out = tally(gold, "total_gold")
    for df in (tally(extracted, "total_extracted"), scores):
        out = out.join(df, list(keys) or "_all", "full")
    out = out.drop("_all")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = out.select(*keys, *(zero(c) for c in out.columns if c not in keys))
    out = out.withColumn("missing_entries", F.col("total_gold") - F.col("paired")).withColumn("extra_entries", F.col("total_extracted") - F.col("paired"))
    return with_rates(out).drop("paired")


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall and overall_f1 from exact_matches, partial_matches, total_gold, total_extracted."""
    hit = F.col("exact_matches") + F.col("partial_matches")
    p, r = ratio_or_zero(hit, "total_extracted"), ratio_or_zero(hit, "total_gold")
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("overall_f1", ratio_or_zero(2 * p * r, p + r))


def field_pairs(records: DataFrame, keys: Sequence[str] = (), fields: Sequence[str] = COMPARED) -> DataFrame:
    """records: keys, g_seq, and the structs gold and extracted. A row for each compared field whose gold text isn't blank:
    raw texts (gold_raw, ext_raw) and normalised ones (gt, ext)."""
    one = lambda i, f: F.struct(F.lit(i).alias("field_no"), F.lit(f).alias("field"), F.coalesce(F.col(f"gold.{f}"), F.lit("")).alias("gold_raw"), F.coalesce(F.col(f"extracted.{f}"), F.lit("")).alias("ext_raw"))
    rows = records.select(*keys, F.col("g_seq").alias("pair_seq"), F.explode(F.array(*(one(i, f) for i, f in enumerate(fields)))).alias("x")).select(*keys, "pair_seq", "x.*")
    rows = rows.withColumn("gold_raw", strip("gold_raw")).withColumn("ext_raw", strip("ext_raw")).where(F.col("gold_raw") != "")
    return rows.withColumn("gt", normalize_text("gold_raw")).withColumn("ext", normalize_text("ext_raw"))


def error_totals(pairs: DataFrame, by: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """Character and word totals and rates of pairs (gt, ext), micro-averaged.

    rollup: with subtotals over by (null), else one row per group."""
    rows = pairs.select(
        *by, F.length("gt").alias("c"), char_distance("gt", "ext").alias("ce"), F.size(tokens("gt")).alias("w"), word_distance("gt", "ext").alias("we")
    )
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    sums = grouped.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("c", "total_chars"), ("ce", "char_errors"), ("w", "total_words"), ("we", "word_errors"))))
    return sums.withColumn("cer", ratio_or_zero("char_errors", "total_chars")).withColumn("wer", ratio_or_zero("word_errors", "total_words"))


def word_errors(pairs: DataFrame, by: Sequence[str] = (), mode: str = "shortest") -> DataFrame:
    """Words replaced, dropped and added in pairs (gt, ext), and the word error rate. mode: shortest, or blocks (of difflib)."""
    rows = pairs.select(*by, F.size(tokens("gt")).alias("w"), word_ops("gt", "ext", mode).alias("o")).select(*by, "w", "o.*")
    sums = rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("w", "total_words"), *((o, f"word_{o}") for o in WORD_OPS))))
    return sums.withColumn("wer", ratio_or_zero(sum((F.col(f"word_{o}") for o in WORD_OPS), F.lit(0)), "total_words"))


def edit_rows(pairs: DataFrame, keys: Sequence[str] = (), mode: str = "shortest") -> DataFrame:
    """A row for each edit of pairs: keys, pair_seq, field_no, field, gold_raw, ext_raw, op_no, op, gt, ext, pos."""
    where = [*keys, "pair_seq", "field_no", "field", "gold_raw", "ext_raw"]
    dealt = pairs.repartition(*keys, "pair_seq", "field_no")  # a small file is one task's, whatever its edits
    return dealt.select(*where, F.posexplode(edit_ops("gt", "ext", mode)).alias("op_no", "x")).select(*where, "op_no", "x.*")


def op_rates(edits: DataFrame, totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key the numbers of each kind of edit and their share of all gold characters. totals: of error_totals."""
    counts = _grouped(edits, keys, *(F.count_if(F.col("op") == o).alias(f"{o}s") for o in OPS))
    both = (totals if keys else totals.withColumn("_all", F.lit(0))).join(counts, list(keys) or "_all", "left")
    n = lambda o: F.coalesce(F.col(f"{o}s"), F.lit(0))
    return both.select(*keys, "total_chars", *(n(o).alias(f"{o}s") for o in OPS), *(ratio_or_zero(n(o), "total_chars").alias(f"{o}_rate") for o in OPS))


def _first() -> Column:
    return F.min(F.struct("pair_seq", "field_no", "op_no")).alias("first")


def confusions(edits: DataFrame, keys: Sequence[str] = (), top: int | None = 30) -> DataFrame:
    """Counts of (op, gold character, extracted character), their share of the op, and their rank: by count, then by
    first appearance. top: ranks kept of each op; shares are of all."""
    counts = stored(edits.groupBy(*keys, "op", "gt", "ext").agg(F.count(F.lit(1)).alias("n"), _first()), "confusions")
    own = [*keys, "op"]
    totals = counts.groupBy(*own).agg(F.sum("n").alias("total"))
    if top is None:  # all ranks: by a distributed scan, as no task may see all confusions of an op
        ranked = scanned_by_parts(counts.withColumn("_less", -F.col("n")), own, ["_less", "first"], {"rank": F.lit(1)}).drop("_less")
    else:  # the best of each salt first
        order = (F.desc("n"), "first")
        salted = counts.withColumn("_salt", F.pmod(F.xxhash64("gt", "ext"), F.lit(SALTS)))
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*own, "_salt").orderBy(*order))).where(F.col("rank") <= top)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("rank") <= top).drop("_salt")
    shared = same_keys(ranked, totals, own, "inner")
    return shared.select(*own, "gt", "ext", "n", (F.col("n") / F.col("total")).alias("share"), F.col("rank").cast("int").alias("rank"))


def confusion_examples(edits: DataFrame, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """For each (op, gt, ext) its (gold, extracted) raw texts, one for each edit, in order. most: as many at most.

    Without most a list grows with the edits: for reports of any size, example_rows has a row for each."""
    rows = edits
    if most is not None:  # ranked first, so that no list grows beyond it; by salts, so that no task sorts all of a confusion
        own, order = [*keys, "op", "gt", "ext"], ("pair_seq", "field_no", "op_no")
        salted = edits.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS))).repartition(*own, "_salt")  # before it is sorted
        best = salted.withColumn("k", F.row_number().over(Window.partitionBy(*own, "_salt").orderBy(*order))).where(F.col("k") <= most)
        rows = best.withColumn("k", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("k") <= most)
    listed = rows.groupBy(*keys, "op", "gt", "ext").agg(F.array_sort(F.collect_list(F.struct("pair_seq", "field_no", "op_no", "gold_raw", "ext_raw"))).alias("x"))
    return listed.select(*keys, "op", "gt", "ext", F.transform("x", lambda s: F.struct(s["gold_raw"].alias("gold"), s["ext_raw"].alias("extracted"))).alias("examples"))


def example_rows(edits: DataFrame, confusions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """confusions (of confusions()) with a row for each edit: n, share, rank, gold_raw and ext_raw, and the edit's place."""
    shown, own = stored(confusions, "shown"), [*keys, "op", "gt", "ext"]
    rows = edits.select(*own, "pair_seq", "field_no", "op_no", "gold_raw", "ext_raw")
    if shown.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(shown), own)
    return rows.hint("merge").join(shown, own)  # Spark takes edits for as small as the texts, and would broadcast them


def field_stats(pairs: DataFrame, edits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per field: characters, edits of each kind, and the character error rate."""
    chars = pairs.groupBy(*keys, "field").agg(F.sum(F.length("gt")).alias("chars"))
    ops = edits.groupBy(*keys, "field").agg(*(F.count_if(F.col("op") == o).alias(f"{o}s") for o in OPS))
    out = chars.join(ops, [*keys, "field"], "left")
    n = [F.coalesce(F.col(f"{o}s"), F.lit(0)) for o in OPS]
    return out.select(*keys, "field", "chars", *(c.alias(f"{o}s") for c, o in zip(n, OPS, strict=True)), ratio_or_zero(n[0] + n[1] + n[2], "chars").alias("cer"))


def kept_and_dropped(records: DataFrame, keep: Column, keys: Sequence[str] = ()) -> DataFrame:
    return records.groupBy(*keys).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
