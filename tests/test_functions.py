from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import edits, geometry, similarity, text
from scriptorium.sources.readers import records_of_answers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ("   Bpə,  ", "врә;"), ("PƏ", "pə"), ("b", "b"), ("\x1c x \x1f", "x"), ("A,B", "a;в")],
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_text(F.lit(raw).cast("string"))) == want


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit(" a  b\tc\x1cd "))) == ["a", "b", "c", "d"]


@pytest.mark.parametrize(("raw", "want"), [("```json\n[1]\n```", "[1]"), (" ```\n{}\n``` ", "{}"), ("[1]", "[1]"), ("```json[1]```", "[1]")])
def test_fence(spark, raw, want):
    assert one(spark, text.strip_code_fence(F.lit(raw))) == want


def test_answers(spark):
    rows = [(1, '[{"headword_phrase": "a"}, {"headword_phrase": ""}, {"headword_phrase": "b", "entry_type": "phrase"}]'), (2, '{"entries": [{"headword_phrase": "c", "pos": null}]}'), (3, '{"headword_phrase": "d"}'), (4, "no json")]
    got = records_of_answers(spark.createDataFrame(rows, "page int, answer string"), strict=False).collect()
    assert [(r.page, r.seq, r.headword_phrase, r.entry_type, r.pos) for r in sorted(got)] == [(1, 0, "a", "word", ""), (1, 2, "b", "phrase", ""), (2, 0, "c", "word", ""), (3, 0, "d", "word", "")]
    with pytest.raises(Exception, match="no JSON records"):
        records_of_answers(spark.createDataFrame(rows[3:], "page int, answer string")).collect()


def test_small_functions(spark):
    path = F.lit("/a/b.c/file.name.png")
    assert one(spark, text.stem(path)) == "file.name" and one(spark, text.name(path)) == "file.name.png" and one(spark, text.with_suffix(path, ".tsv")) == "/a/b.c/file.name.tsv"
    assert one(spark, text.has_pos_tag(F.lit("word (сущ.) x"))) and not one(spark, text.has_pos_tag(F.lit("word (1.)")))
    assert one(spark, text.is_entry_start(F.lit("x (гл.)"))) and not one(spark, text.is_entry_start(F.lit("см. x")))
    assert one(spark, text.entry_id(F.lit("L"), F.lit(7))) == "L007" and one(spark, text.block_id(F.lit(12))) == "block_012"
    assert one(spark, text.fixed(F.lit(0.31675), 4)) == f"{0.31675:.4f}" and one(spark, text.percent(F.lit(0.5))) == "50.00%"
    assert one(spark, text.key_variable(F.lit("openrouter/gemini"))) == "OPENROUTER_API_KEY" and one(spark, text.key_variable(F.lit("other"))) is None
    assert one(spark, text.base64_text(F.lit(b"x" * 100))) == __import__("base64").b64encode(b"x" * 100).decode()
    assert one(spark, text.ratio_or_zero(F.lit(1), F.lit(0))) == 0.0


def test_geometry(spark):
    poly = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((3, 9), (1, 4), (7, 5))))
    assert tuple(one(spark, geometry.polygon_box(poly))) == (1.0, 4.0, 7.0, 9.0)
    df = spark.range(1).select(geometry.polygon_box(poly).alias("bbox")).select(geometry.crop_box("bbox", F.lit(10), F.lit(100), 5).alias("x"))
    assert tuple(df.first().x) == (0, 0, 10, 14)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, up = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
def test_edit_script(a, b):
    ops = edits.edit_script(a, b)
    kinds = [o[0] for o in ops]
    assert len(ops) == _distance(a, b) and kinds.count("deletion") - kinds.count("insertion") == len(a) - len(b)
    out, at = [], 0  # replayed on a, it gives b
    for op, gt, ext, pos in ops:
        if op == "insertion":
            while len(out) < pos:
                out.append(a[at])
                at += 1
            out.append(ext)
        else:
            while at < pos:
                out.append(a[at])
                at += 1
            assert a[at] == gt
            at += 1
            out += [ext] if op == "substitution" else []
    assert "".join(out) + a[at:] == b


def test_edit_preferences():
    assert [o[:3] for o in edits.edit_script("п", "ul")] == [("insertion", "", "u"), ("substitution", "п", "l")]
    assert [o[0] for o in edits.edit_script("ab", "c")] == ["substitution", "deletion"] or [o[0] for o in edits.edit_script("ab", "c")] == ["deletion", "substitution"]
    assert [o[0] for o in edits.block_script("abc", "xyzc")] == ["substitution", "substitution", "insertion"]


def test_long_scripts(monkeypatch):
    """Rows that are made again give the script of the whole table; nothing is too long."""
    rng = random.Random(4)
    for _ in range(30):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 90))) for _ in range(2))
        want = edits.edit_script(a, b)
        with monkeypatch.context() as m:
            m.setattr(edits, "HELD", 0)
            assert edits.edit_script(a, b) == want
            assert edits.edit_script(a.split(), b.split()) == edits.edit_script(a.split(), b.split())
    assert len(edits.edit_script("a" * 9_000, "b" * 8_000)) == 9_000


def test_word_ops(spark):
    rng = random.Random(7)
    rows = [(" ".join(rng.choices("abcd", k=rng.randint(0, 9))), " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", edits.word_distance("a", "b").alias("d"), edits.word_ops("a", "b").alias("o"), edits.word_ops("a", "b", "blocks").alias("f")).collect()
    for r in got:
        assert sum(r.o) == r.d and r.o.deletions - r.o.insertions == len(r.a.split()) - len(r.b.split())
        want = {"replace": 0, "delete": 0, "insert": 0, "equal": 0}
        for tag, i, i2, j, j2 in SequenceMatcher(None, r.a.split(), r.b.split()).get_opcodes():
            want[tag] += max(i2 - i, j2 - j)
        assert tuple(r.f) == (want["replace"], want["delete"], want["insert"])


def test_word_distance(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("abcdefg", k=rng.randint(0, 9))), " ".join(rng.choices("abcdefg", k=rng.randint(0, 9)))) for _ in range(100)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", edits.word_distance("a", "b").alias("d")).collect()
    assert all(r.d == _distance(r.a.split(), r.b.split()) for r in got)


def test_similarity():
    assert similarity.similarity("", "") == 1.0 and similarity.similarity("", "x") == similarity.similarity("x", "") == 0.0
    assert similarity.similarity("tide", "diet") == SequenceMatcher(None, "tide", "diet").ratio() != similarity.similarity("diet", "tide")


@pytest.mark.parametrize(("threshold", "together"), [(0.7, similarity.TOGETHER), (0.7, ()), (0.5, similarity.TOGETHER), (0.9, similarity.TOGETHER), (0.7, ((4, 3), (9, 2)))])
def test_keys_are_sound(spark, threshold, together):
    """Whatever reaches the threshold has a key in common."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=rng.randint(0, 12))) for _ in range(60)] + ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(14, 55))) for _ in range(8)]
    words += [w[:k] + "z" * n + w[k + m :] for w in words[-30:] for k, n, m in [(rng.randint(0, len(w)), rng.randint(0, 3), rng.randint(0, 3))]]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string").withColumn("b", similarity.bag("w"))
    keys: dict[str, set] = {}
    for r in similarity.with_keys(df, "b", threshold, together).collect():
        keys.setdefault(r.w, set()).add(r.token)
    near = 0
    for x in keys:
        for y in keys:
            if similarity.similarity(x, y) >= threshold:
                near += 1
                assert keys[x] & keys[y], (x, y)
    assert set(keys) == set(words) and near > len(keys)