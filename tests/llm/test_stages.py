"""The pipeline's stages, one by one and in a row, on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from scriptorium.llm import packing
from scriptorium.llm.common import stored, table

#: Names that the stages use themselves, or that need quoting.
CLASH = ["_cut", "_new", "cut", "new", "of", "toxic_score", "toxic_clauses", "_t", "h", "__row", "__gone", "_again", "score", "a.b", "n", "k1", "token", "doc id", "component_id", "_0", "nr", "__hit_h", "gone", "row"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASH)
FILTERS = corpus_pipeline.STAGES[:4]


def _texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9))))
    return lambda n: " ".join(word() for _ in range(n))


@pytest.fixture(scope="module")
def made():
    text = _texts(11)
    passage, leaked, long = text(70), text(14), text(30_000)
    near = text(200)
    rows = [
        (1, None), (1, None), (None, None), (2, ""), (3, " \n\t"), (None, ""),  # nothing to judge
        (4, f"{text(30)} idiot {text(5)} idiot, you idiot moron {text(30)}"), (None, f"{text(30)} you idiot, moron idiot {text(20)}"),  # toxic
        (5, near), (6, near + " tail"), (None, near), (7, near), (7, "x " + near),  # near copies
        (None, leaked), (8, f"{text(40)} {leaked} {text(40)}"), (None, f"{text(20)} {leaked.upper()}"), (8, text(90)),  # leaked, and a clean row with the same id
        (9, f"{text(100)} {passage} {text(100)}"), (10, f"{text(120)} {passage} {text(120)}"), (None, f"{text(110)} {passage} {text(110)}"),  # a passage
        (11, long), (12, "äöü 你好 \U0001f600 é"), (13, "single"),
    ]
    return [(i, t, None, "s", None if t is None else len(t), *range(len(CLASH))) for i, t in rows], leaked, passage


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, made):
    """A folder of tables: labels that teach two words, a benchmark with one item."""
    rows, leaked, _ = made
    folder, text = tmp_path_factory.mktemp("sf"), _texts(12)
    taught = [(1000 + i, f"{text(40)} {'idiot ' * (i % 2)}{text(30)} {'moron idiot ' * (i % 2)}{text(10)}") for i in range(400)]
    spark.createDataFrame([*rows, *((i, t, "en", "s", len(t), *range(len(CLASH))) for i, t in taught)], DOCS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i, _ in taught] + [(None, None, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leaked, 5), (1, leaked, 5), (None, "x", 1), (2, None, 1), (3, "", 1)], "item_id long, text string, h long").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/none.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def _left(df):
    """Without the rows that teach."""
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if (r.doc_id or 0) < 1000), key=repr)


def _given(made):
    return [(r[0], r[1]) for r in made[0]]


@pytest.mark.parametrize(("name", "stage"), FILTERS)
def test_columns_and_empty_tables(spark, docs, sf, name, stage):
    """Every column stays as it is, in its place; an empty table gives an empty one."""
    out = stored(stage(spark, docs, sf), name)
    assert out.dtypes == docs.dtypes and out.count() > 0
    kept = [r for r in out.collect() if r.text is not None]
    assert all(tuple(r)[5:] == tuple(range(len(CLASH))) and r.n_chars == len(r.text) for r in kept)
    empty = stage(spark, docs.limit(0), sf)
    assert empty.dtypes == docs.dtypes and empty.count() == 0


def test_toxicity(spark, docs, sf, made):
    assert _left(corpus_pipeline.stage_toxicity(spark, docs, sf)) == sorted((x for x in _given(made) if "idiot" not in (x[1] or "")), key=repr)


def test_jaccard_join(spark, docs, sf, made):
    near = made[0][8][1]
    left = _left(corpus_pipeline.stage_jaccard_join(spark, docs, sf))
    assert [x for x in left if near in (x[1] or "")] == [(5, near)]
    assert [x for x in left if near not in (x[1] or "")] == sorted((x for x in _given(made) if near not in (x[1] or "")), key=repr)


def test_substring_dedup(spark, docs, sf, made):
    """The passage stays in its first document only; a row without doc_id comes after all others."""
    passage = made[2]
    left = _left(corpus_pipeline.stage_substring_dedup(spark, docs, sf))
    assert [i for i, t in left if t and passage in t] == [9]
    assert sum(1 for i, t in left if i is None and t is None) == 1 and (12, made[0][-2][1]) in left and (11, made[0][-3][1]) in left
    assert len([x for x in left if x[0] in (9, 10)]) == 2 and sum(len(t.split()) for i, t in left if i == 10) == 240


def test_decontamination(spark, docs, sf, made):
    """Rows are judged by their own texts, with or without doc_id."""
    leaked = made[1]
    assert _left(corpus_pipeline.stage_decontaminate(spark, docs, sf)) == sorted((x for x in _given(made) if leaked not in (x[1] or "").lower()), key=repr)


def test_packing(spark, docs, sf, made):
    rows = corpus_pipeline.stage_packing(spark, docs, sf).collect()
    enc = packing.Encoder(packing.tokenizer_path())
    want = [len(enc.whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect()]
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert all(a == sum(n for _, n in spans[:k]) for k, (a, _) in enumerate(spans)) and sum(n for _, n in spans) <= 4096
    assert sum(want) == sum(r.length for r in rows) and sum(r.piece == 0 for r in rows) == len(want)
    assert corpus_pipeline.stage_packing(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf, made):
    """All stages in a row. What has nothing to judge is packed; toxic, copied and leaked rows are not."""
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in rows if r.piece == 0 and (r.doc_id is None or r.doc_id < 1000)]
    assert sorted(i for i in ids if i is not None) == [1, 1, 2, 3, 5, 8, 9, 10, 11, 12, 13]
    assert ids.count(None) == 3  # two without words, and what is left around the passage
    assert not [r for r in rows if r.doc_id is not None and r.doc_id >= 1000 and r.doc_id % 2]
    assert sum(r.piece == 0 for r in rows if (r.doc_id or 0) >= 1000) == 200
