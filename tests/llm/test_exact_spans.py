"""op5_substring_dedup against brute force over words: every repeated passage of over 50 words, to the word, and no other."""

from __future__ import annotations

from collections import defaultdict

from pathlib import Path

import numpy as np
import pytest

from scriptorium.llm import substring_dedup
from scriptorium.llm.common import table

SF = "/root/testdata/sf0.001"


def _run(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(1, 10)))) for _ in range(n))


def _spans(spark, rows):
    out = defaultdict(list)
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[r.doc_id].append(r)
    return out


def _repeated_words(rows, size=51):
    """For each document, the words in passages that an earlier document has."""
    seen, out = set(), defaultdict(set)
    for i, t in sorted(rows):
        w = t.split()
        own = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        for k, x in enumerate(own):
            if x in seen:
                out[i] |= set(range(k, k + size))
        seen |= set(own)
    return out


def test_all_passages_to_the_word(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        passage = _run(rng, int(rng.choice([50, 51, 51, 52, 60, 200])))
        rows += [(2 * k + j, f"{_run(rng, int(rng.integers(0, 90)))} {passage} {_run(rng, int(rng.integers(0, 90)))}".strip()) for j in (0, 1)]
    text, found, want = dict(rows), _spans(spark, rows), _repeated_words(rows)
    assert set(found) == set(want) and len(want) > 300
    for i, spans in found.items():
        (r,) = spans
        assert r.n_words == len(want[i]) and r.source_doc_id == i - 1
        assert text[i].encode()[r.start : r.stop].decode() == " ".join(text[i].split()[k] for k in sorted(want[i]))


def test_pieces_of_several_documents_are_no_passage(spark):
    """Words that stand in earlier documents only by pieces are left alone; a passage with two sources is cut whole."""
    rng = np.random.default_rng(4)
    pieces = [_run(rng, 40) for _ in range(6)]
    long = _run(rng, 150).split()
    rows = [(k, f"{_run(rng, 30)} {p} {_run(rng, 30)}") for k, p in enumerate(pieces)]
    rows += [(10, " ".join(pieces)), (20, " ".join(long[:90])), (21, " ".join(long)), (22, f"start {' '.join(long)} end"), (22, "start " + " ".join(long[60:]))]
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    found = _spans(spark, rows)
    assert set(found) == {21, 22}
    for i, spans in found.items():
        for r in spans:
            assert any(t.encode()[r.start : r.stop].decode() in text[r.source_doc_id][0] for t in text[i]) and r.n_words > 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in substring_dedup.stage_substring_dedup(spark, df, "").collect() if r.doc_id > 20)
    assert left == [(21, " ".join(long[90:])), (22, "start"), (22, "start end")]


def test_random_texts_by_brute_force(spark):
    """Repeats inside a document, periods, copies, common passages and joined pieces of earlier documents."""
    rng = np.random.default_rng(5)
    pool = [_run(rng, int(rng.integers(20, 120))) for _ in range(12)]
    rows = [(i, " ".join([*(pool[j] if rng.random() < 0.6 else _run(rng, 15) for j in rng.integers(0, 12, int(rng.integers(1, 8)))), "x y " * int(rng.choice([0, 0, 40]))]).strip()) for i in range(150)]
    want, found, text = _repeated_words(rows), _spans(spark, rows), dict(rows)
    got = defaultdict(set)
    for i, spans in found.items():
        raw = text[i].encode()
        for r in spans:
            a = len(raw[: r.start].split())
            assert raw[r.start : r.stop].decode() in text[r.source_doc_id] and r.source_doc_id < i and len(raw[r.start : r.stop].split()) == r.n_words
            got[i] |= set(range(a, a + r.n_words))
    assert got == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stage_by_brute_force(spark):
    df = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    gone, left = _repeated_words(rows), {r.doc_id: r.text for r in substring_dedup.stage_substring_dedup(spark, df, "").collect()}
    want = {i: [w for k, w in enumerate(t.split()) if k not in gone[i]] for i, t in rows}
    assert gone and {i: (t or "").split() for i, t in left.items()} == {i: w for i, w in want.items() if w or not gone[i]}


def _documents(spark, rows):
    """Rows in the operator's order of documents, numbered."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").distinct()
    found = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    return sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))


def test_rows_without_or_with_shared_ids_are_documents_of_their_own(spark):
    rng = np.random.default_rng(8)
    pool = [_run(rng, int(rng.integers(51, 90))) for _ in range(10)]
    ids = [None, None, None, 7, 7, 8, *range(20, 60)]
    rows = [(ids[int(rng.integers(0, len(ids)))], f"{_run(rng, 20)} {pool[int(rng.integers(0, 10))]} {_run(rng, 20)} {pool[int(rng.integers(0, 10))]}") for _ in range(90)]
    rows += [(None, f"{_run(rng, 9)} {pool[0]}"), (7, f"{_run(rng, 9)} {pool[0]}"), (7, rows[0][1]), rows[0], rows[0]]
    docs = _documents(spark, rows)
    want = _repeated_words([(k, r.text) for k, r in enumerate(docs)])
    at = {(r.doc_id, r.h): k for k, r in enumerate(docs)}
    got = defaultdict(set)
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        raw = docs[at[r.doc_id, r.h]].text.encode()
        first = len(raw[: r.start].split())
        got[at[r.doc_id, r.h]] |= set(range(first, first + r.n_words))
    assert got == want and sum(docs[k].doc_id is None for k in got) > 5 and sum(docs[k].doc_id == 7 for k in got) > 2
    left = substring_dedup.stage_substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    words = [[w for k, w in enumerate(r.text.split()) if k not in want[at[r.doc_id, r.h]]] for r in docs]
    # rows that are equal are one document: each is cut alike
    times = defaultdict(int)
    for r in rows:
        times[r] += 1
    expected = [(r.doc_id, w) for r, w in zip(docs, words, strict=True) for _ in range(times[r.doc_id, r.text]) if w]
    assert sorted(((r.doc_id, r.text.split()) for r in left), key=repr) == sorted(expected, key=repr)


def test_many_rows_without_ids_take_time_in_proportion(spark):
    import time

    rng = np.random.default_rng(9)
    passage, took = _run(rng, 60), []
    for n in (500, 2_000, 20_000):
        df = spark.createDataFrame([(None, f"w{k} x{k} {passage} y{k}") for k in range(n)], "doc_id long, text string")
        began = time.time()
        left = substring_dedup.stage_substring_dedup(spark, df, "").select("text").collect()
        took.append(time.time() - began)
        assert sum(passage in r.text for r in left) == 1 and len(left) == n
    assert took[2] < 10 * max(took[0], took[1])  # 40 times the rows of the first
