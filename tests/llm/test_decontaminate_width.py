"""op10_decontaminate with other widths than the query's."""

from __future__ import annotations

import pytest

from scriptorium.llm import decontaminate


@pytest.mark.parametrize("width", [1, 3, 10, 14, 25])
def test_width_by_brute_force(spark, width):
    """The rarest word stands at every offset of some window."""
    item = " ".join(f"w{i}" for i in range(26))
    rows = [(0, "pad " * 30 + item + " pad" * 30), (1, " ".join(item.split()[:13])), (2, item), (3, "other words " * 20)]
    rows += [(10 + k, " ".join(f"w{i}" for i in range(26) if i != k)) for k in range(26)]
    bench = [(7, item), (8, "short item")]
    windows = {tuple(w[k : k + min(len(w), width)]) for _, t in bench for w in [t.split()] for k in range(len(w) - min(len(w), width) + 1)}
    want = {}
    for i, t in rows:
        w, hit = t.split(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        want[i] = len(hit)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), width).collect()
    assert {r.doc_id: r.n_hit for r in got} == want


def test_one_term(spark):
    """Windows of one distinct word, at the query's own width."""
    docs = spark.createDataFrame([(1, "a lone b"), (2, "so so so"), (3, "so so")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Lone"), (2, "so so so")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench).collect()} == {1: 1, 2: 3, 3: 0}
