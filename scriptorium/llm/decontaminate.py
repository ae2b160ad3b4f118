"""Benchmark decontamination with a distributed positional inverted index. DataFrame and SQL functions only.

Method: a first pass counts the benchmark's terms in the corpus. For every test window its LISTS rarest terms are
looked up; the index holds the postings (term, document, position) of just these terms and is stored in the shared
folder. Postings shifted by their term's offset give window starts; a start that all lists of a window have (their
intersection, from the rarest term on) is compared word by word with the window, in the text around the rarest
term's posting. Exact phrases are the contract; ``proximity`` returns looser matches from the same index.

Term lookup folds all letters (a superset of the A-Z folding of the contract); the comparison folds A-Z only.

Defined cases: a null text has no words. A benchmark row with null item_id or without words is left out. Repeated
benchmark rows count once; repeated documents each get their row, and those that share doc_id and text share the
result. Empty tables: no benchmark gives zero hits, no documents an empty result. Texts of any length are read whole.
Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WINDOW = 10
#: Posting lists intersected for each window.
LISTS = 2
#: Bytes of test terms (each with ROW more) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES, ROW = 32_000_000, 32
#: Stands for a null doc_id.
NO_ID = -(2**63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before A-Z are folded.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    """Words, with an empty string at an end that has a separator. Never an empty array."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATOR, -1)


def _az(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _id() -> Column:
    """doc_id to join by: a value stands for null, as the result depends on the text alone."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def _n_words(words: Column) -> Column:
    n = F.size(words)
    return (n - F.when(words[0] == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)).cast("long")


def test_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: phrase, terms (folded for lookup), n, and the items that have it."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", F.filter(_split(_az(F.col("text"))), lambda w: w != "").alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(width))
    spans = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("w"))
    return spans.groupBy(F.array_join("w", " ").alias("phrase")).agg(
        F.min(F.transform("w", F.lower)).alias("terms"), F.min(F.size("w")).alias("n"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )


def _checked(terms: DataFrame, bound: int) -> tuple[DataFrame, bool]:
    """terms, marked for broadcast if they take no more bytes than the bound."""
    small = (terms.agg(F.sum(F.octet_length("t") + ROW)).first()[0] or 0) <= bound
    return (F.broadcast(terms) if small else terms), small


def _occurrences(docs: DataFrame, *more: Column) -> DataFrame:
    """A row for each word: doc_id, h (of the text), p (position), t (folded term)."""
    words = docs.select(_id(), F.xxhash64("text").alias("h"), _split(F.col("text")).alias("w"))
    # the arrays are never empty: "outer" only keeps the optimizer from splitting every text twice to test that
    return words.select("doc_id", "h", "w", F.posexplode_outer("w").alias("p", "t")).withColumn("t", F.lower("t"))


def rarest_terms(docs: DataFrame, windows: DataFrame, lists: int = LISTS, bound: int = BROADCAST_BYTES) -> DataFrame:
    """For each window that the corpus can hold, its rarest distinct terms: phrase, n, t, o (offset), r (rank from 0)."""
    terms, _ = _checked(stored(windows.select(F.explode("terms").alias("t")).distinct(), "terms"), bound)
    counts = _occurrences(docs).join(terms, "t").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    each = windows.select("phrase", "n", F.posexplode("terms").alias("o", "t")).groupBy("phrase", "n", "t").agg(F.min("o").alias("o")).join(counts, "t", "left")
    ranked = each.groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t", "o"))).alias("s"))
    return ranked.where("s[0].df > 0").select("phrase", "n", F.posexplode(F.slice("s", 1, lists)).alias("r", "x")).select("phrase", "n", "r", "x.t", "x.o")


def positional_index(docs: DataFrame, seeds: DataFrame, bound: int = BROADCAST_BYTES, around: int = WINDOW) -> DataFrame:
    """Postings of the seeds' terms: t, doc_id, h, p, and where a window has the term as its rarest, the words around it."""
    terms, small = _checked(stored(seeds.groupBy("t").agg((F.min("r") == 0).alias("lead")), "seeds"), bound)
    if small:
        near = F.slice("w", F.greatest(F.col("p") + 2 - around, F.lit(1)), 2 * around - 1)
        found = _occurrences(docs).join(terms, "t").select("t", "doc_id", "h", "p", F.when(F.col("lead"), near).alias("near"))
        return stored(found, "postings")
    found = stored(_occurrences(docs).drop("w").join(terms, "t"), "postings")
    led = found.where("lead").join(docs.select(_id(), F.xxhash64("text").alias("h"), "text").dropDuplicates(["doc_id", "h"]), ["doc_id", "h"])
    led = led.select("t", "doc_id", "h", "p", F.slice(_split(F.col("text")), F.greatest(F.col("p") + 2 - around, F.lit(1)), 2 * around - 1).alias("near"))
    return led.unionByName(found.where("NOT lead").select("t", "doc_id", "h", "p", F.lit(None).cast("array<string>").alias("near")))


def phrase_hits(docs: DataFrame, windows: DataFrame, lists: int = LISTS, width: int = WINDOW) -> DataFrame:
    """Exact occurrences of windows of at most width words: doc_id, h, start (of the word, from 0), n, phrase."""
    seeds = stored(rarest_terms(docs, windows, lists).withColumn("w", F.xxhash64("phrase")), "rarest")
    index = positional_index(docs, seeds, around=width)
    # the rarest term's list, as starts of windows
    begun = index.where("near IS NOT NULL").join(seeds.where("r = 0").select("t", "o", "w"), "t").where("p >= o")
    begun = begun.select("doc_id", "h", (F.col("p") - F.col("o")).alias("start"), "w", F.col("p").alias("at"))
    # the other lists, shifted by their terms' offsets: which of them have the start as well
    others = seeds.where("r > 0").select("w", "t", "o", "r")
    asked = begun.join(others, "w").select("doc_id", "h", "start", "w", "at", "r", "t", (F.col("start") + F.col("o")).alias("p"))
    met = asked.join(index.select("doc_id", "h", "t", "p"), ["doc_id", "h", "t", "p"]).groupBy("doc_id", "h", "start", "w", "at").agg(F.countDistinct("r").alias("met"))
    need = seeds.groupBy("w").agg(F.max("r").alias("need"))
    shared = met.join(need, "w").where("met = need").select("doc_id", "h", "start", "w", "at")
    alone = begun.join(need.where("need = 0"), "w", "left_semi")
    found = shared.unionByName(alone).distinct()
    # word by word
    near = index.where("near IS NOT NULL").select("doc_id", "h", F.col("p").alias("at"), "near").dropDuplicates(["doc_id", "h", "at"])
    text = seeds.where("r = 0").select("w", "phrase", "n")
    here = F.slice("near", F.least(F.col("at") + 1, F.lit(width)) - (F.col("at") - F.col("start")), F.col("n"))
    return found.join(near, ["doc_id", "h", "at"]).join(text, "w").where(_az(F.array_join(here, " ")) == F.col("phrase")).select("doc_id", "h", "start", "n", "phrase")


def hit_texts(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """A stored row for each document (by doc_id, as of _id(), and the hash h of its text) with a hit: n_hit, ids (items)."""
    windows = stored(test_windows(benchmark, width), "windows")
    hits = phrase_hits(docs, windows, width=width).join(windows.select("phrase", "items"), "phrase")
    zero = F.lit(0).cast("long")
    spans = F.array_sort(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("stop"))))
    covered = F.aggregate(
        spans, F.struct(zero.alias("n"), zero.alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["to"]), zero)).alias("n"), F.greatest(a["to"], s["stop"]).alias("to")), lambda a: a["n"],
    )
    by = hits.groupBy("doc_id", "h").agg(covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    return stored(by, "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    by = hit_texts(docs, benchmark, width)
    all_ = docs.select(F.col("doc_id").alias("own"), _id(), F.xxhash64("text").alias("h"), _n_words(_split(F.col("text"))).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return all_.join(by, ["doc_id", "h"], "left").select(
        F.col("own").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, phrases: DataFrame, slack: int = 3) -> DataFrame:
    """Places where all of a phrase's indexed rarest terms stand within its length plus slack, in any order.

    phrases: as of test_windows. Gives doc_id, h, phrase, first, last (word positions), one row for each place where
    such a group begins."""
    seeds = stored(rarest_terms(docs, phrases), "rarest")
    index = positional_index(docs, seeds)
    at = index.join(seeds, "t").groupBy("doc_id", "h", "phrase", "n").agg(F.array_sort(F.collect_set(F.struct("p", "r"))).alias("ps"))
    need = seeds.groupBy("phrase").agg(F.count(F.lit(1)).alias("need"))
    group = lambda x: F.filter("ps", lambda y: (y["p"] >= x["p"]) & (y["p"] < x["p"] + F.col("n") + slack))
    places = at.join(need, "phrase").withColumn("g", F.explode(F.transform("ps", group)))
    full = places.where(F.size(F.array_distinct(F.transform("g", lambda y: y["r"]))) == F.col("need"))
    return full.select("doc_id", "h", "phrase", F.col("g")[0]["p"].alias("first"), F.element_at("g", -1)["p"].alias("last")).distinct()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents. Defined cases: a row is judged by its own text, so a contaminated one without doc_id
    goes, and a clean one that shares its doc_id stays; all columns are kept as they are, whatever their names."""
    bad = hit_texts(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))  # stored: Spark sees its size and picks the join
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    return docs.join(bad, (own == bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["h"]), "left_anti")


_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM
    (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM
    (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.k, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n),
cov AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (k) LEFT JOIN its USING (k)"""

QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL = {"op10_decontaminate": _SQL}
