"""op1_quality_rules: small languages and sources are judged by their language, or else by the whole table."""

from __future__ import annotations

import random

from scriptorium.llm import quality_rules


def test_small_cells_are_judged(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda: " ".join(word() for _ in range(rng.randint(60, 300)))
    junk = lambda: " ".join("*%&$#|" * 7 + word() for _ in range(100))
    rows = [(i, text(), "en", "web") for i in range(300)] + [(300 + i, text(), "en", "rare") for i in range(5)] + [(310, junk(), "en", "rare")]
    rows += [(400 + i, text(), "xx", None) for i in range(5)] + [(410, junk(), "xx", "web"), (411, junk(), None, None)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all((r.distance2 is None) == r.base_failed for r in got.values())
    assert not any(got[i].base_failed or got[i].kept for i in (310, 410, 411))
    assert all(got[i].kept for i in (*range(300, 305), *range(400, 405)))
