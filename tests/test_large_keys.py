"""Assignments and ranks where one key holds everything."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import matching, metrics
from scriptorium.operators.components import components
from scriptorium.sources import table_functions


def _sequential(pairs):
    taken, done, out = set(), set(), []
    for g, e, s in sorted(pairs, key=lambda p: (p[0], -p[2], p[1])):
        if g not in done and e not in taken:
            done.add(g)
            taken.add(e)
            out.append((g, e))
    return sorted(out)


@pytest.mark.parametrize("keys", [[], ["page"]])
def test_a_chain_is_settled_in_some_rounds(spark, keys, monkeypatch):
    """Each pair waits for the one before: gold k may have e k or e k + 1, and prefers the one that k - 1 leaves."""
    n, stars = 100_000, []
    pairs = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("g_seq"), F.explode(F.array(F.struct(F.col("id").alias("e"), F.lit(0.9).alias("s")), F.struct((F.col("id") + 1).alias("e"), F.lit(0.8).alias("s")))).alias("x"))
    # backwards, so that the first round settles next to nothing
    pairs = pairs.select(*keys, "g_seq", (F.lit(n) - F.col("x.e")).alias("e_seq"), F.when(F.col("x.e") == F.col("g_seq"), 0.8).otherwise(0.9).alias("overall"))
    rounds = []
    settled = matching._settled
    monkeypatch.setattr(matching, "_settled", lambda *a: rounds.append(1) or settled(*a))
    got = matching.greedy_match(pairs, keys, at_once=1_000).select("g_seq", "e_seq").collect()
    want = _sequential([(g, n - g - 1, 0.9) for g in range(n)] + [(g, n - g, 0.8) for g in range(n)])
    assert sorted(map(tuple, got)) == want and len(rounds) <= matching.ROUNDS and not stars


@pytest.mark.parametrize("at_once", [3, 40])
def test_random_assignments_by_components(spark, at_once):
    rng = random.Random(at_once)
    rows = [(rng.choice(["a", "b", "c"]), g, rng.randint(0, 60), rng.choice([0.0, 0.5, 0.7, 0.9])) for g in range(60) for _ in range(rng.randint(1, 4))]
    rows = list({(k, g, e): (k, g, e, s) for k, g, e, s in rows}.values())
    got = matching.greedy_match(spark.createDataFrame(rows, "k string, g_seq long, e_seq long, overall double"), ["k"], at_once).collect()
    for key in "abc":
        assert sorted((r.g_seq, r.e_seq) for r in got if r.k == key) == _sequential([(g, e, s) for k, g, e, s in rows if k == key and s > 0])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000, 1000)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}


@pytest.mark.parametrize("top", [5, 200, None])
def test_ranks_of_many_confusions(spark, top):
    """Ties go by the first appearance; shares are of all, not of those that are shown."""
    n = 60_000
    edits = spark.range(n).select(
        F.lit("substitution").alias("op"), F.col("id").alias("pair_seq"), F.lit(0).alias("field_no"), F.lit(0).alias("op_no"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 40_000).cast("string")).alias("gt"), F.lit("x").alias("ext"),
    )
    counts: dict = {}
    for i in range(n):
        g = "hot" if i % 3 == 0 else str(i % 40_000)
        c = counts.setdefault(g, [0, i])
        c[0] += 1
    want = sorted(((-c, first, g) for g, (c, first) in counts.items()))[:top]
    got = sorted(metrics.confusions(edits, top=top).collect(), key=lambda r: r["rank"])
    assert [(r.gt, r.n, r["rank"]) for r in got] == [(g, -c, k + 1) for k, (c, _, g) in enumerate(want)]
    assert got[0].share == counts["hot"][0] / n


def test_table_function(spark):
    table_functions.register(spark)
    rows = [(1, "dog (n.) hound\ncat", "k"), (2, None, "k"), (3, "", "z")]
    spark.createDataFrame(rows, "id long, text string, page2 string").createOrReplaceTempView("some_items")
    got = spark.sql("SELECT * FROM extract_records(TABLE(some_items), 'pattern')")
    assert got.columns == ["id", "page2", *table_functions.MADE]
    assert sorted((r.id, r.seq, r.headword_phrase, r.entry_type) for r in got.collect()) == [(1, 0, "dog", "word"), (1, 1, "cat", "word")]
    given = spark.sql("""SELECT * FROM extract_records(TABLE(SELECT 1 AS id, '[{"headword_phrase": "a"}' AS text UNION ALL SELECT 2, '{"headword_phrase": "b", "pos": [1]}' UNION ALL SELECT 3, NULL UNION ALL SELECT 4, '3'), 'given')""")
    assert {r.id: (r.headword_phrase, r.pos, (r.error or "").split(":")[0]) for r in given.collect()} == {1: (None, None, "JSONDecodeError"), 2: ("b", "[1]", ""), 3: (None, None, "ValueError"), 4: (None, None, "ValueError")}
    for bad, message in (("TABLE(SELECT 1 AS x), 'pattern'", "column text"), ("TABLE(some_items), 'nothing'", "unknown model")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM extract_records({bad})")


def _ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_pieces_lose_no_pair(spark, threshold):
    from scriptorium.functions.similarity import edit_ratio

    rng = random.Random(int(threshold * 10))
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(0, 12)))
    gold = [(rng.choice("xy"), word()) for _ in range(150)] + [("x", ""), ("y", "")]
    other = [(k, "".join(c if rng.random() > 0.15 else rng.choice(["", "b", "ca"]) for c in w)) for k, w in gold] + [("x", "")]
    sides = spark.createDataFrame(gold, "k string, g_head string"), spark.createDataFrame(other, "k string, e_head string")
    for keys in (["k"], []):
        got = {(*(r[k] for k in keys), r.g_head, r.e_head) for r in matching.similar_heads(*sides, keys, threshold, edit_ratio, page=0).collect()}
        want = {(*([k] if keys else []), g, e) for k, g in gold for k2, e in other if (k == k2 or not keys) and _ratio(g, e) >= threshold - 1e-12}
        assert got == want
