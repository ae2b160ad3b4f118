"""Operators against brute force, exact round trips, SQL, planted cases and held-out accuracy, on the small tables."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from scriptorium.llm import decontaminate, html_text, importance, jaccard_join, language_id, packing, quality_rules, registry, substring_dedup, toxicity
from scriptorium.llm.common import table, word_hashes, words_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_word_hashes():
    buf, starts, ends, first = words_of([b"a bb  a", b"", b" bb\n", b"ccc"])
    h = word_hashes(buf, starts, ends).tolist()
    assert first.tolist() == [0, 3, 3, 4, 5] and h[0] == h[2] and h[1] == h[3] and len(set(h)) == 3


def _naive_statistics(text: str) -> tuple[int, ...]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_statistics(docs):
    for r in docs.values():
        assert quality_rules.statistics(r.text.encode())[:5] == _naive_statistics(r.text)


def _mcd_by_steps(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The operator's estimate in numpy: mean, inverse covariance, log determinant, and the start that gave it."""
    mid = np.median(v, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(v - mid), axis=0), quality_rules.UNIT * np.array([f for _, f in quality_rules.FEATURES]))
    z = (v - mid) / scale
    far = np.linalg.norm(z, axis=1)[:, None]
    t, u = np.rint(np.tanh(z) * quality_rules.UNIT), np.rint(np.divide(z, far, out=np.zeros_like(z), where=far > 0) * quality_rules.UNIT)
    upper = lambda m: np.array([m[i, j] for i, j in quality_rules._PAIRS])
    first = quality_rules.starts(len(v), mid, scale / quality_rules.UNIT, np.concatenate((t.sum(axis=0), upper(t.T @ t))), upper(u.T @ u))

    def step(mean, inv):
        d = v / quality_rules.UNIT - mean
        g = np.floor(np.log2(1 + np.maximum(np.einsum("ni,ij,nj->n", d, inv, d), 0)) * quality_rules.FINE)
        w = v[g <= np.sort(g)[math.ceil(quality_rules.SHARE * len(v)) - 1]]
        return quality_rules.estimate(len(w), w.sum(axis=0).astype(float), upper(w.T @ w).astype(float))

    tried = []
    for k, inv in enumerate(first):
        now = mid / quality_rules.UNIT, inv, math.inf
        for _ in range(quality_rules.TRIED):
            was, now = now[2], step(*now[:2])
        tried.append((now[2], k, was, now))
    det, start, was, now = min(tried, key=lambda x: x[:2])
    for _ in range(quality_rules.STEPS - quality_rules.TRIED):
        if was - now[2] < quality_rules.TOLERANCE:
            break
        was, now = now[2], step(*now[:2])
    return *now, start


def _cell_rows(spark, cells: dict[str, np.ndarray]):
    rows = [(c, *map(int, r)) for c, v in cells.items() for r in v]
    return spark.createDataFrame(rows, "cell string, x0 long, x1 long, x2 long, x3 long, x4 long").repartition(3)


def test_mcd(spark):
    """Estimates of cells, some with a fifth of far rows, against the same steps in numpy."""
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(size=(900, 5)) @ rng.normal(size=(5, 5)) * 300 + 2000).astype(int)
    x[:100] += 9000
    y = np.rint(rng.normal(size=(300, 5)) * [400, 30, 90, 1, 0] + 500).astype(int)
    y[:60, 0] += np.arange(60) * 50
    cells = {"a": x[:500], "b": x[500:], "c": y}
    got = {r.cell: r for r in quality_rules.mcd(_cell_rows(spark, cells | {"few": x[:50]})).collect()}
    assert set(got) == set(cells)
    for c, v in cells.items():
        mean, inv, det, _ = _mcd_by_steps(v)
        assert np.allclose([got[c][f"m{k}"] for k in range(5)], mean) and got[c].det == pytest.approx(det)
        assert np.allclose([got[c][f"p{i}_{j}"] for i, j in quality_rules._PAIRS], [inv[i, j] for i, j in quality_rules._PAIRS])
        if c == "a":
            d = v[:100] / quality_rules.UNIT - mean
            assert np.einsum("ni,ij,nj->n", d, inv, d).min() > quality_rules.chi2_quantile(quality_rules.CUT, 5)
    assert quality_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_mcd_is_the_least(spark):
    """On small cells with outliers the estimate is that of the least determinant of all subsets of the share."""
    from itertools import combinations

    rng = np.random.default_rng(8)
    cells = {}
    for k in range(12):
        v = rng.normal(size=(16, 5)) @ rng.normal(size=(5, 5)) * 2_000 + 20_000
        v[:4] += rng.choice([-1, 1], 5) * rng.uniform(15_000, 40_000)
        cells[f"c{k}"] = np.rint(v).astype(int)
    got = {r.cell: r.det for r in quality_rules.mcd(_cell_rows(spark, cells), least=16).collect()}
    same = 0
    for c, v in cells.items():
        every = (v[list(i)] for i in combinations(range(16), 12))
        least = min(quality_rules.estimate(12, w.sum(axis=0).astype(float), np.array([(w[:, i] * w[:, j]).sum() for i, j in quality_rules._PAIRS], float))[2] for w in every)
        assert least - 1e-6 < got[c] < least + 1
        same += got[c] < least + 1e-6
    assert same >= 10


def test_floor():
    f = np.array([x for _, x in quality_rules.FEATURES])
    assert np.allclose(quality_rules.floored(np.zeros((5, 5))), np.diag(f**2))
    wide = np.diag((3 * f) ** 2)
    assert np.allclose(quality_rules.floored(wide), wide)  # a floor adds nothing above it


def test_kept_over_the_table(spark):
    """Every verdict of a whole table: base rules, cells and pools, distances, the cut."""
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality_rules.op1_quality_rules(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    vectors, by = {}, defaultdict(list)
    for r in docs:
        n_words, chars, symbols, dup, repeated, lines = quality_rules.statistics((r.text or "").encode())
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        assert rows[r.doc_id].base_failed == failed
        if not failed:
            x = [math.log1p(n_words), math.log(chars / n_words), math.sqrt(symbols / n_words), math.sqrt(dup / max(lines, 1)), repeated / n_words]
            vectors[r.doc_id] = np.array([math.floor(min(v, 31.0) * quality_rules.UNIT + 0.5) for v in x])
            for key in ((r.lang, r.source), (r.lang,), ()):
                by[key].append(r.doc_id)
    models, different = {}, 0
    for r in docs:
        if r.doc_id not in vectors:
            assert not rows[r.doc_id].kept
            continue
        key = next((k for k in ((r.lang, r.source), (r.lang,), ()) if len(by[k]) >= quality_rules.LEAST), None)
        if key not in models:
            models[key] = _mcd_by_steps(np.array([vectors[i] for i in by[key]]))
        mean, inv = models[key][:2]
        d = vectors[r.doc_id] / quality_rules.UNIT - mean
        different += rows[r.doc_id].kept != bool(d @ inv @ d <= quality_rules.chi2_quantile(quality_rules.CUT, 5))
    assert len(models) > 2 and different == 0


def test_quality_by_labels(spark):
    """Labelled good texts that pass the base rules stay; labelled bad ones mostly go."""
    sf = SF.replace("0.001", "0.01")
    rows = quality_rules.op1_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_token_ids(docs):
    enc = packing.Encoder(packing.tokenizer_path())
    odd = ["It's 3.14 'S DON'T", "<|endoftext|> a", "<|ENDOFTEXT|>", "É é é H̱", "İstanbul ΑΣ", "a\x1cb\x85c d", "foo,bar. baz!!! q?!\n", "ßªº x_y", "你好 world", "word### a&&& b-c d...", " x　y"]
    for t in [*odd, *(r.text for r in docs.values())]:
        want = enc.whole.encode(t, add_special_tokens=False).ids
        assert struct.unpack(f"<{len(want)}I", enc.ids(t.encode())) == tuple(want), t


def test_packing(spark, docs):
    rows = packing.op2_best_fit_packing(spark, SF).collect()
    enc = packing.Encoder(packing.tokenizer_path())
    want = {}
    for i, r in docs.items():
        ids = [*enc.whole.encode(r.text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096] = (k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert all(a == sum(n for _, n in spans[:k]) for k, (a, _) in enumerate(spans)) and sum(n for _, n in spans) <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_fullest_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = sorted({int(x) for x in rng.integers(1, 30, 4)}, reverse=True)
        counts = [int(x) for x in rng.integers(1, 4, len(lengths))]
        room = int(rng.integers(1, 60))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        got = packing.fullest(list(zip(lengths, counts, strict=True)), room)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)
        assert all(k <= dict(zip(lengths, counts, strict=True))[n] for n, k in got.items())


def _naive_grams(text: str) -> Counter:
    n: Counter = Counter()
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    for w in low.split():
        p = f" {w} "
        for i in range(1, len(p) - 1):
            n.update((p[i], p[i - 1 : i + 1], p[i - 1 : i + 2]))
    return n


def _ranked(n: Counter) -> dict[str, int]:
    key = lambda g: tuple([0] * (3 - len(g)) + [1 if c == " " else ord(c) + 2 for c in g])
    return {g: k for k, g in enumerate(sorted(n, key=lambda g: (-n[g], key(g)))[: language_id.PROFILE])}


def test_language_profiles(spark, docs):
    by: dict[str, Counter] = defaultdict(Counter)
    for i, r in docs.items():
        if zlib.crc32(str(i).encode()) % 4 != 2:
            by[r.lang].update(_naive_grams(r.text))
    known = {k: _ranked(n) for k, n in by.items()}
    right = []
    for r in language_id.op3_language_id(spark, SF).collect():
        own, text = _ranked(_naive_grams(docs[r.doc_id].text)), docs[r.doc_id]
        far = {k: sum(abs(k2 - p[g]) if g in p else language_id.PROFILE for g, k2 in own.items()) for k, p in known.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (len(own) * language_id.PROFILE))
        right += [r.lang_pred == text.lang] * r.held_out
    assert np.mean(right) > 0.95


def _naive_links(texts: dict[int, str], words: int, percent: int) -> tuple[dict[int, int], dict[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    ids, root, degree = sorted(sets), {i: i for i in sets}, Counter()
    for a in range(len(ids)):
        for b in ids[a + 1 :]:
            x, y = sets[ids[a]], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                degree[ids[a]] += 1
                degree[b] += 1
                u, v = root[ids[a]], root[b]
                if u != v:
                    root = {k: min(u, v) if r in (u, v) else r for k, r in root.items()}
    return root, degree


def test_jaccard_in_blocks(spark, monkeypatch):
    """A large group of near copies, dealt over many blocks, among unrelated texts that share a passage."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2_000)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base, passage = [word() for _ in range(90)], " ".join(word() for _ in range(40))
    texts = {}
    for i in range(260):
        w = base.copy()
        for k in rng.integers(0, 90, rng.integers(0, 7)):
            w[k] = word()
        texts[i] = " ".join(w)
    for i in range(260, 320):
        texts[i] = " ".join(word() for _ in range(30)) + " " + passage
    texts[320] = texts[0]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(df).collect()}
    root, degree = _naive_links(texts, 4, 85)
    assert {i: r.component_id for i, r in got.items()} == root
    assert {i: r.n_links for i, r in got.items()} == {i: degree[i] for i in texts}


def test_substring_planted(spark):
    """Passages of 51 to 80 words planted in other texts are found; texts without one are left alone."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(1, 10))))
    run = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for k in range(150):
        passage = run(int(rng.integers(51, 81)))
        for j in range(2):
            rows.append((3 * k + j, f"{run(int(rng.integers(5, 200)))} {passage} {run(int(rng.integers(5, 200)))}"))
        want.add(3 * k + 1)
        rows.append((3 * k + 2, run(250)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_spans(df).collect()
    got = {r.doc_id for r in found}
    assert got <= want and len(got) >= 0.97 * len(want)
    text = dict(rows)
    for r in found:
        assert r.source_doc_id == r.doc_id - 1 and text[r.doc_id].encode()[r.start : r.stop] in text[r.source_doc_id].encode()
    left = {r.doc_id: r.text for r in substring_dedup.without_spans(df, substring_dedup.repeated_spans(df)).collect()}
    spans = {r.doc_id: r for r in found}
    for i, t in text.items():
        if i in spans:
            assert len(left[i].split()) == len(t.split()) - spans[i].n_words
        else:
            assert left[i] == t


def test_gear_rolls():
    words = np.random.default_rng(2).integers(0, 2**63, 500, dtype=np.uint64)
    want = [sum(int(words[i - k]) << (4 * k) for k in range(min(i + 1, 16))) % 2**64 for i in range(500)]
    assert substring_dedup.gear(words).tolist() == want
    got, h = substring_dedup.anchors(words, 51), substring_dedup.mixed(np.array(want, np.uint64))
    assert got.tolist() == [min(h[i + 15 : i + 51].tolist()) for i in range(450)]


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    rows = toxicity.op7_toxicity(spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    caught, spared = ([r.predicted for r in rows if r.toxic == t] for t in (1, 0))
    assert len(caught) > 50 and np.mean(caught) > 0.8 and np.mean(spared) < 0.02


def test_grammar():
    s = toxicity.Scorer({"idiot": 5.0}, -2.2)
    score = lambda t: s.score(t)[0]
    assert score("an idiot") > 0.9 > 0.7 > score("not an idiot") > score("no such thing")
    assert score("they said an idiot") < score("an idiot") < score("you idiot")
    assert score("kill the lights") == score("lights") < score("you kill")


def test_importance(spark, docs):
    got = importance.resample(table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")).collect()
    assert sum(r.kept for r in got) == math.ceil(0.75 * len(docs))
    for r in got[:40]:
        assert r.n_grams == max(2 * len(docs[r.doc_id].text.encode().split()) - 1, 0)
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert np.mean([r.kept for r in got if quality.get(r.doc_id) == 1]) > 0.9 > 0.3 > np.mean([r.kept for r in got if quality.get(r.doc_id) == 0])


def test_importance_by_brute_force(spark, docs):
    """Log weights from counts of every text's hashed words and pairs, and the selection by sums with the same noise."""
    labels = table(spark, SF, "labels")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}

    def grams(text: str) -> Counter:
        words = [w.lower() for w in text.encode().split()]
        h = word_hashes(*words_of([b" ".join(words)])[:3]) if words else np.zeros(0, np.uint64)
        pairs = [int(importance.windows(h[k : k + 2], 2)[0]) for k in range(len(h) - 1)]
        return Counter(x >> 49 for x in [*h.tolist(), *pairs])

    own = {i: grams(r.text) for i, r in docs.items()}
    raw, target = sum(own.values(), Counter()), sum((n for i, n in own.items() if i in good), Counter())
    size = importance.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    want = {i: sum(ratio(b) * k for b, k in n.items()) for i, n in own.items()}
    df = table(spark, SF, "documents").select("doc_id", "text")
    got = {r.doc_id: r for r in importance.resample(df, labels).collect()}
    assert all(got[i].n_grams == own[i].total() and got[i].log_weight == pytest.approx(w, abs=1e-5) for i, w in want.items())
    noise = {r.doc_id: r.g for r in df.select("doc_id", importance.gumbel().alias("g")).collect()}
    order = sorted(want, key=lambda i: -(got[i].log_weight + noise[i]))
    assert {i for i, r in got.items() if r.kept} == set(order[: math.ceil(importance.SELECT * len(docs))])


def test_kth_greatest(spark):
    v = [int(x) for x in np.random.default_rng(4).integers(-(2**50), 2**50, 500)] + [7] * 5
    df = spark.createDataFrame([(x,) for x in v], "q long")
    for k in (1, 2, 100, 505):
        assert importance.kth_greatest(df, "q", k) == sorted(v, reverse=True)[k - 1]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha filler omega " + "the " * 9), (2, "omega then alpha"), (3, "alpha " + "the " * 40 + "omega")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha the omega")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.proximity(df, decontaminate.test_windows(bench), slack=2).collect()} == {1, 2}


def test_rendering():
    page = "<html><head><title>T</title><style>x</style></head><body><h1>Head</h1>one <b>two</b>\n three<p>four<br>five<ol start=3><li>a<li>b<ul><li>c</ul></ol>" \
        "<table><tr><th>Name<th>Qty<tr><td>apple<td align=right>3<tr><td rowspan=2>x<td>1<tr><td>2</table><p hidden>no</p><i style='display: none'>no</i>&lt;end&gt;<pre>\n a\n  b</pre>"
    assert html_text.render(page) == "Head\n\none two three\n\nfour\nfive\n\n3. a\n4. b\n\n   - c\n\nName   Qty\napple    3\nx      1\n       2\n\n<end>\n\n a\n  b"


def test_pipeline(spark, docs):
    """All stages by brute force."""
    left = {i: r.text for i, r in docs.items()}
    scorer = toxicity.Scorer(*toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels").where(~toxicity.held_out())))
    left = {i: t for i, t in left.items() if scorer.score(t)[0] < toxicity.CUT}
    root, _ = _naive_links(left, 5, 80)
    left = {i: t for i, t in left.items() if root[i] == i}
    seen: set[tuple] = set()
    for i in sorted(left):  # words in passages of MIN_WORDS words that an earlier document has
        w = left[i].split()
        own = [tuple(w[k : k + substring_dedup.MIN_WORDS]) for k in range(len(w) - substring_dedup.MIN_WORDS + 1)]
        gone = {j for k, x in enumerate(own) if x in seen for j in range(k, k + substring_dedup.MIN_WORDS)}
        seen |= set(own)
        if gone:
            left[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    left = {i: t for i, t in left.items() if t.split()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        n = min(len(w), 10)
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    left = {i: t for i, t in left.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}
    enc = packing.Encoder(packing.tokenizer_path())
    want = set()
    for i, t in left.items():
        ids = [*enc.whole.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, k // 4096, len(ids[k : k + 4096]), zlib.crc32(struct.pack(f"<{len(ids[k : k + 4096])}I", *ids[k : k + 4096]))) for k in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
