"""Plans, and bounds of what a task holds, that keep queries within limits as tables grow."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import edits as edits_module
from scriptorium.functions import pieces
from scriptorium.functions.edits import edit_distance
from scriptorium.functions.blocks import similarity
from scriptorium.functions.similarity import edit_ratio
from scriptorium.operators import matching, metrics


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_headwords_are_not_broadcast(spark, monkeypatch):
    """A headword has hundreds of keys, which Spark takes for as small as the headword."""
    rng, plans = random.Random(3), []
    g = sorted({"".join(rng.choices("abcd", k=rng.randint(5, 9))) for _ in range(matching.PAGE + 50)})
    e = sorted({w[:2] + rng.choice("abx") + w[3:] for w in rng.sample(g, 200)})
    sides = [spark.createDataFrame([(w,) for w in ws], f"{s}_head string") for ws, s in ((g, "g"), (e, "e"))]
    kept = matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name: (plans.append(_plan(df)) if name == "met" else None) or kept(df, name))
    got = {(r.g_head, r.e_head) for r in matching.similar_heads(*sides, similarity=edit_ratio).collect()}
    assert got == {(a, b) for a in g for b in e if 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.7}
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_edits_are_not_broadcast(spark):
    """Edits are many for each text, but Spark takes them for as small as the texts."""
    rows = spark.range(300).select(F.col("id").alias("pair_seq"), F.lit(0).alias("field_no"), F.lit("f").alias("field"), F.lit("abc").alias("gt"), F.lit("xyz").alias("ext"), F.lit("abc").alias("gold_raw"), F.lit("xyz").alias("ext_raw"))
    edits = metrics.edit_rows(rows)
    got = metrics.example_rows(edits, metrics.confusions(edits))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join Inner" in x)
    assert "rightHint=(strategy=broadcast)" in join and "leftHint=(strategy=broadcast)" not in join and got.count() == 900


def test_many_confusions_are_not_broadcast_either(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FEW", 2)
    rows = spark.createDataFrame([(k, 0, "f", "abc", "xyz", "abc", "xyz") for k in range(20)], "pair_seq long, field_no int, field string, gt string, ext string, gold_raw string, ext_raw string")
    edits = metrics.edit_rows(rows)
    got = metrics.example_rows(edits, metrics.confusions(edits))
    assert "BroadcastHashJoin" not in _plan(got) and got.count() == 60


def test_edits_are_handed_over_in_pieces(monkeypatch):
    monkeypatch.setattr(edits_module, "AT_A_TIME", 10)
    scripts = [edits_module.edit_script("abcdefg"[:k], "xyzuvwr"[: 7 - k]) for k in [7, 0, 3, 7, 7, 2] * 5]
    pieces = list(edits_module._listed(iter(scripts)))
    assert max(len(p.flatten()) for p in pieces) < 10 + 7 and len(pieces) > 10
    assert [[tuple(x.values()) for x in r] for p in pieces for r in p.to_pylist()] == scripts and not list(edits_module._listed([]))


def test_first_examples_are_ranked_by_salts(spark):
    """No task sorts all edits of a confusion, and the first ones are the same."""
    rng = random.Random(8)
    rows = [(rng.randrange(1_000), k % 3, "f", "ab" * 2, "xb" * 2, f"g{k}", f"e{k}") for k in range(900)]
    rows = list({r[:2]: r for r in rows}.values())
    found = metrics.edit_rows(spark.createDataFrame(rows, "pair_seq long, field_no int, field string, gt string, ext string, gold_raw string, ext_raw string"))
    listed = metrics.confusion_examples(found, most=5)
    plan = _plan(listed)
    assert plan.rindex("_salt", 0, plan.rindex("ArrowEvalPython")) and "WindowGroupLimit" not in plan[plan.rindex("Exchange hashpartitioning(op") :]
    want = [(r[5], r[6]) for r in sorted(rows) for _ in range(2)][:5]
    assert [tuple(x) for x in listed.first().examples] == want


def _copies(n: int, other: bool) -> list[tuple]:
    """Few headwords and kinds, so that classes have many records, under two pages."""
    rng = random.Random(11 + other)
    heads = ["old bolt", "cold bolt", "bold ring", "old ring", "gold ring", ""]
    return [(rng.choice("pq"), 1_000 * other + k, rng.choice(heads), rng.choice(["n", "v"]), rng.choice(["ring", "bolts", "rings"])) for k in range(n)]


def _in_turn(gold, other, similarity) -> set[tuple]:
    out, used = set(), set()
    for page, seq, *g in sorted(gold):
        best = None
        for page_, e_seq, *e in other:
            if page_ == page and (page, e_seq) not in used and (h := similarity(g[0], e[0])) >= 0.7:
                s = 0.5 * h + 0.15 * similarity(g[1], e[1]) + 0.35 * similarity(g[2], e[2])
                if s > 0 and (best is None or (-s, e_seq) < best):
                    best = (-s, e_seq)
        if best:
            used.add((page, best[1]))
            out.add((page, seq, best[1], round(-best[0], 9)))
    return out


@pytest.mark.parametrize("at_once,sparse", [(1_000_000, 4), (1, 0), (1, 1_000_000)])
@pytest.mark.parametrize("named", ["edit", "blocks"])
def test_records_of_equal_fields_are_assigned_by_classes(spark, monkeypatch, at_once, sparse, named):
    monkeypatch.setattr(matching, "SPARSE", sparse)
    gold, other = _copies(70, False), _copies(60, True)
    sides = [spark.createDataFrame(x, "page string, seq int, Headword_Phrase string, POS string, Translation_RU string") for x in (gold, other)]
    measure = {"edit": edit_ratio, "blocks": matching.ratio}[named]
    by_hand = {"edit": lambda a, b: 1 - edit_distance(a, b) / max(len(a), len(b)) if a or b else 1.0, "blocks": similarity}[named]
    pairs, *members = matching._class_pairs(*sides, ["page"], matching.HEAD, measure)
    got = matching._greedy_by_classes(pairs, *members, ["page"], at_once)
    assert got.schema["g_seq"].dataType.simpleString() == "int"
    assert {(r.page, r.g_seq, r.e_seq, round(r.overall, 9)) for r in got.collect()} == _in_turn(gold, other, by_hand)
    if at_once > 1:
        monkeypatch.setattr(matching, "TOGETHER_AT_MOST", 2)
        all_pairs = matching._expanded(pairs, *members, ["page"]).select("page", "g_seq", "e_seq").collect()
        assert sorted(map(tuple, all_pairs)) == sorted((p, g, e) for p, g, *a in gold for q, e, *b in other if p == q and by_hand(a[0], b[0]) >= 0.7)


def test_pairs_of_classes_do_not_grow_with_their_records(spark):
    head = [F.lit(x).alias(c) for c, x in (("Headword_Phrase", "bolt"), ("POS", "n"), ("Translation_RU", "ring"))]
    side = spark.range(20_000).select(F.col("id").alias("seq"), *head)
    pairs, *members = matching._class_pairs(side, side, [], matching.HEAD, edit_ratio)
    assert pairs.count() == 1
    got = matching.match_records(side, side, similarity=edit_ratio)
    assert got.where("g_seq = e_seq").count() == got.count() == 20_000


def test_distances_of_long_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcé😀 ", k=rng.choice([0, 5, 64, 65, 300]))) for _ in range(40)]
    rows = [(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)] + [(None, "a" * 70), ("a" * 70, None), (None, None)]
    got = spark.createDataFrame(rows, "gt string, ext string").select(edits_module.char_distance("gt", "ext").alias("ours"), F.levenshtein("gt", "ext").alias("built_in")).collect()
    assert all(r.ours == r.built_in for r in got)


def _names(n: int, start: int = 0) -> tuple[list[str], list[str]]:
    """Random names and their changed copies, as in similar_heads_whole."""
    g = [hashlib.md5(str(k).encode()).hexdigest()[: 16 + k % 4] for k in range(start, start + n)]
    return g, [x[:4] + x[5:10] + "xy" + x[11:] for x in g]


def test_few_pairs_of_headwords_reach_the_distance(spark, monkeypatch):
    """Pairs that have a piece in common grow with the square of the headwords; those whose distance is computed don't."""
    g, e = _names(2_000)
    sides = [spark.createDataFrame([(w,) for w in ws], f"{s}_head string") for ws, s in ((g, "g"), (e, "e"))]
    compared, kept = [], matching.stored
    monkeypatch.setattr(matching, "within_edits", lambda *a: F.lit(True))
    monkeypatch.setattr(matching, "stored", lambda df, name: compared.append(kept(df, name)) or compared[-1] if name == "met" else kept(df, name))
    got = {(r.g_head, r.e_head) for r in matching.similar_heads(*sides, similarity=edit_ratio).collect()}
    assert got >= set(zip(g, e, strict=True)) and compared[0].count() < 1.5 * len(got)


@pytest.mark.parametrize("keys", [["page"], []])
def test_headwords_of_a_hot_key_are_compared_in_blocks(spark, monkeypatch, keys):
    """All headwords begin alike: their key is dealt to many blocks and tasks, and no pair is lost."""
    monkeypatch.setattr(matching, "TOGETHER_IN_BLOCK", 7)
    monkeypatch.setattr(matching, "COMPARED_BY_A_TASK", 500)
    rng, sizes, kept = random.Random(6), [], matching.stored
    word = lambda: "abcd" + "".join(rng.choices("abé😀", k=rng.randint(0, 5)))
    sides = [{(rng.choice("pq"), word()) for _ in range(120)} | {("p", ""), (None, "abcd")} for _ in "ge"]
    frames = [spark.createDataFrame(sorted(x, key=str), f"page string, {s}_head string") for x, s in zip(sides, "ge", strict=True)]

    def stored(df, name):
        out = kept(df, name)
        if name.endswith("blocks"):
            sizes.append(max(len(r[0]) for r in out.select(f"{name[0]}_heads").collect()))
        return out

    monkeypatch.setattr(matching, "stored", stored)
    got = {tuple(r)[:-1] for r in matching.similar_heads(*frames, keys, similarity=edit_ratio, page=0).collect()}
    fits = lambda a, b: 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.7 if a or b else True
    assert got == {(*([p] if keys else []), a, b) for p, a in sides[0] for q, b in sides[1] if (p == q is not None or not keys) and fits(a, b)}
    assert sizes == [7, 7]


@pytest.mark.parametrize("table", [1, 10**9])
@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.85])
def test_pieces_and_bounds_are_sound(monkeypatch, threshold, table):
    """Two texts that reach the threshold have a key in common and are compared, in tables and pair by pair."""
    monkeypatch.setattr(pieces, "TABLE", table)
    monkeypatch.setattr(pieces, "AT_ONCE", 60)
    rng = random.Random(9)
    for letters in ("ab", "0123456789abcdef", "abcdé😀" + "".join(map(chr, range(0x400, 0x430)))):
        g = sorted({"".join(rng.choices(letters, k=rng.randint(0, 20))) for _ in range(60)})
        e = sorted({"".join(rng.choice(["", "x", c + rng.choice(letters)]) if rng.random() < 0.2 else c for c in w) for w in g})
        near = {(a, b) for a in g for b in e if (1 - edit_distance(a, b) / max(len(a), len(b)) if a or b else 1.0) >= threshold}
        g_lengths, e_lengths = ({len(x) for x in side} for side in (g, e))
        keys = lambda x, asked: {int(k[0]) for k in pieces.keys_of(pieces.letters(pa.array([x]), len(x)), asked)}
        asked = {x: keys(x, pieces.asked_keys(len(x), e_lengths, g_lengths, threshold)) for x in g}
        own = {x: keys(x, pieces.own_keys(len(x), g_lengths, threshold)) for x in e}
        assert all(asked[a] & own[b] for a, b in near)
        lists = pa.array([g, [], g[:9]]), pa.array([e, e[:3], e])
        flat = [x.flatten().to_pylist() for x in lists]
        found = {(int(r), flat[0][p], flat[1][q]) for rows, ps, qs in pieces.near_pairs(*lists, threshold) for r, p, q in zip(rows, ps, qs, strict=True)}
        assert found >= {(0, *x) for x in near} | {(2, *x) for x in near if x[0] in g[:9]} and not any(r == 1 for r, *_ in found)
