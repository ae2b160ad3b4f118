"""The pipeline's stage jaccard_join where doc_id is null or repeated."""

from __future__ import annotations

import numpy as np

from scriptorium.llm import jaccard_join


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    a, b, c, d, e = (text(200) for _ in range(5))
    near = lambda t: t + " tail"
    rows = [
        (None, a), (None, a), (None, near(a)),  # a group without ids
        (None, b), (5, b), (4, near(b)),  # with some: 4 stays
        (7, c), (7, c), (8, near(c)),  # a repeated id: one row stays
        (9, d), (9, near(e)), (10, e), (None, e),  # one id of two groups: the least id of each stays
        (None, None), (None, None), (11, ""), (12, None),  # without words: all stay
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    left = jaccard_join.stage_jaccard_join(spark, df, "")
    assert left.columns == df.columns
    got = sorted(r.k for r in left.collect())
    assert len({0, 1, 2} & set(got)) == 1 and len({6, 7} & set(got)) == 1
    assert [k for k in got if k not in (0, 1, 2, 6, 7)] == [5, 9, 10, 13, 14, 15, 16]
