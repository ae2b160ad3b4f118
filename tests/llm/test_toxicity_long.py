"""op7_toxicity on very long documents: clean ones are left alone at any length, toxic passages in them are caught."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import toxicity
from scriptorium.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_long_clean_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scorer = toxicity.Scorer(*toxicity.learn(docs, labels.where(~toxicity.held_out())))
    rows = docs.join(labels.where(toxicity.held_out()), "doc_id").where("text IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic")).orderBy("text").collect()
    clean, toxic = ([r.text for r in rows if r.toxic == t] for t in (0, 1))
    rng = random.Random(1)

    def joined(n):
        out = []
        while sum(len(t.split()) for t in out) < n:
            out.append(rng.choice(clean))
        return out

    rejected = lambda t: scorer.score(t)[0] >= toxicity.CUT
    assert sum(rejected("\n".join(joined(20_000))) for _ in range(30)) <= 1
    assert sum(rejected("\n".join(joined(100_000))) for _ in range(5)) == 0
    hidden = [joined(10_000) + [t] + joined(10_000) for t in rng.sample([t for t in toxic if rejected(t)], 20)]
    assert sum(rejected("\n".join(t)) for t in hidden) >= 15


def test_stretch():
    score = lambda t: toxicity.Scorer({"idiot": 5.0, "loser": 2.4}, -2.0).score(t)[0]
    filler = "clean words stand here. " * 5_000
    assert score("loser") < toxicity.CUT < score("loser loser")
    assert score(filler + "loser. " + filler + "loser. " + filler) < toxicity.CUT < score(filler + "you idiot, idiot, loser. " + filler)


def test_chance():
    assert toxicity._by_chance(4, 4, 0.5) == pytest.approx(1 / 16) and toxicity._by_chance(3, 4, 0.5) == pytest.approx(5 / 16)
    assert toxicity._by_chance(1, 4, 0.5) == 1.0
