"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: every operator has a result."""

from __future__ import annotations

import hashlib

import pytest

from scriptorium.llm import decontaminate, html_text, importance, jaccard_join, language_id, packing, quality_rules, substring_dedup, toxicity, url_filter
from scriptorium.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", n long, k1 long, h long, score double, length long, kept boolean, token long, w string, n_words long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 3), (4, "one two three four five six seven", None, "s", 1), (4, "one two three four five six seven", None, "s", 1),
    (5, "one two three four five six seven", "en", "s", 1), (None, "one two three four five six seven", "en", "s", 1), (None, None, None, None, None), (6, LONG, "en", "s", 1), (7, LONG + " tail", "de", "s", 1),
    (8, "...!!! ### 123", "fr", "s", 1), (9, "ÄÖÜ ßéñ 你好 é", "de", "s", 1), (10, "x", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *(1, 2, 3, 0.5, 4, True, 5, "w", 6)) for r in ROWS]
    return stored(spark.createDataFrame(rows, DOCS + CLASH), "edge")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS + CLASH)


LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0, "x"), (5, 1, 0, "x"), (6, None, None, None), (None, 1, 1, None), (8, 0, 1, "x"), (99, 1, 1, "x")], LABELS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def test_quality_rules(docs, none):
    got = quality_rules.quality(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert {r.doc_id for r in got if not r.base_failed} <= {6, 7}
    assert quality_rules.quality(none).count() == 0


def test_packing(spark, docs, none):
    got = packing.pack_documents(docs).collect()
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert {r.length for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert max(r.length for r in got) <= 4096
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(none).count() == 0


def test_language_id(docs, none):
    learned = language_id.profiles(docs.select("lang", "text"))
    assert set(learned) == {"en", "de"}
    got = language_id.identify(docs.select("doc_id", "text", "score"), learned).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert language_id.profiles(none.select("lang", "text")) == {}
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), {}).collect()} == {"und"}


def test_jaccard(docs, none):
    got = jaccard_join.jaccard_components(docs.select("doc_id", "text")).collect()
    assert len(got) == len(ROWS)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, r)
    assert of[1].n_shingles == of[2].n_shingles == of[3].n_shingles == 0 and of[2].component_id == 2
    assert of[4].component_id == of[5].component_id == 4 and of[6].component_id == of[7].component_id == 6
    assert of[10].component_id == 10 and of[10].n_shingles == 1
    assert jaccard_join.jaccard_components(none.select("doc_id", "text")).count() == 0
    assert jaccard_join.stage_jaccard_join(docs.sparkSession, docs, "").columns == docs.columns


def test_substring_dedup(docs, none):
    got = substring_dedup.repeated_spans(docs.select("doc_id", "text")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(7, 6)}
    left = substring_dedup.stage_substring_dedup(docs.sparkSession, docs, "")
    assert left.columns == docs.columns and left.where("doc_id = 1").count() == 1
    assert substring_dedup.repeated_spans(none.select("doc_id", "text")).count() == 0
    assert substring_dedup.stage_substring_dedup(none.sparkSession, none, "").count() == 0


def test_url_filter(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no scheme casino", "x"), (4, "HTTP://Ex.ORG", "x"), (5, "http://" + "a" * 50_000 + "/casino", "x"), (5, "http://a.example.org/es/x", "x")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert [(r.page_id, r.verdict) for r in got] == [(1, "allow"), (2, "allow"), (3, "block"), (4, "allow"), (5, "block"), (5, "block")]
    assert (got[0].host, got[0].path, got[3].host, got[3].path, got[5].rule) == ("", "", "ex.org", "", "example.org/es/")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_weights(spark):
    verdict = lambda u, **more: url_filter.UrlJudge(more.get("terms", url_filter.VOCABULARY), (), url_filter.LIMIT).judge(u)[3:]
    assert verdict("http://a.b/casino") == ("block", 1, 0, 6) == verdict("http://a.b/c451n0") == verdict("http://a.b/Casinos?")
    assert verdict("http://a.b/wette/kredit") == ("block", 0, 2, 6) and verdict("http://a.b/wette/wetten/wette") == ("allow", 0, 1, 3)
    assert verdict("http://a.b/best/offer") == ("allow", 0, 2, 2) and verdict("http://a.b/best/offer/now")[0] == "allow" == verdict("http://a.b/best-offer_win")[0]
    assert verdict("http://a.b/best-offer-now_win")[0] == "block"
    assert verdict("http://a.b/casinoroyal/xcasino/free1") == ("allow", 0, 0, 0)
    own = url_filter.read_vocabulary(spark.createDataFrame([("Bad", None, 6), ("bad", "x", 2), ("meh", "m", 3), ("", "e", 6), (None, "n", 6), ("no", "n", None)], "form string, term string, weight int"))
    assert own == {"bad": ("bad", 6), "meh": ("m", 3)}
    assert verdict("http://bad.b", terms=own)[0] == "block" and verdict("http://a.b/casino", terms=own)[0] == "allow" == verdict("http://a.b/casino", terms={})[0]


def test_url_automaton_by_brute_force():
    import random
    import re

    rng, judge = random.Random(4), url_filter.UrlJudge(url_filter.VOCABULARY, (), url_filter.LIMIT)
    forms = sorted(url_filter.VOCABULARY)
    for _ in range(500):
        url = "http://" + "".join(rng.choice([rng.choice(forms), rng.choice(forms).upper(), rng.choice("-/.?é_%"), rng.choice("ax1")]) for _ in range(rng.randint(1, 8)))
        tokens = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), url))
        hit = [url_filter.VOCABULARY[t] for t in tokens if t in url_filter.VOCABULARY]
        strict, found = judge.hits(url)
        assert found == dict(hit) and strict == sum(w >= url_filter.LIMIT for _, w in hit)


def test_toxicity(docs, none, labels, no_labels):
    for ls in (labels, no_labels):
        got = toxicity.score_texts(docs, *toxicity.learn(docs, ls)).collect()
        assert len(got) == len(ROWS) and all(0 <= r.toxic_score < 0.7 for r in got)
    assert toxicity.score_texts(none, *toxicity.learn(none, labels)).count() == 0


def test_html(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>a<p>b", "t"), (3, "<p>a<p>b", "t"), (4, "<div>" * 20_000 + "deep" + "</div>" * 3, "t"), (5, "< not <a tag=\"x> <b>bold</b>", "t"), (6, "x" * 2_000_000, "t")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [r.text for r in got[:5]] == ["", "", "a\n\nb", "a\n\nb", "deep"] and "bold" in got[5].text and len(got[6].text) == 2_000_000
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_importance(docs, none, labels, no_labels):
    for ls in (labels, no_labels):
        got = importance.resample(docs.select("doc_id", "text"), ls).collect()
        assert len(got) == len(ROWS) and sum(r.kept for r in got) >= 0.75 * len(ROWS)
        assert all(r.log_weight == 0 for r in got if r.doc_id in (1, 2, 3))
    assert importance.resample(none.select("doc_id", "text"), labels).count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, "One two, THREE four five six seven"), (1, "One two, THREE four five six seven"), (None, "x"), (2, None), (3, ""), (4, "absent words here")], "item_id long, text string")
    got = decontaminate.contamination(docs.select("doc_id", "text"), bench).collect()
    assert len(got) == len(ROWS)
    hit = [r for r in got if r.contaminated]
    assert sorted(r.doc_id or 0 for r in hit) == [0, 4, 4, 5] and {(r.n_hit, r.n_items, r.n_words) for r in hit} == {(7, 1, 7)}
    assert hit[0].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert decontaminate.contamination(none.select("doc_id", "text"), bench).count() == 0
    clean = decontaminate.contamination(docs.select("doc_id", "text"), bench.where("item_id > 9")).collect()
    assert len(clean) == len(ROWS) and not any(r.contaminated for r in clean)
