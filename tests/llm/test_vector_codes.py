"""Vector codes against full scans in whole numbers; heaps against sorting; edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from scriptorium.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, x long"


def _brute(rows, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    w = -(-max(len(v) for _, v, _ in kept) // 16)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.zeros((len(kept), 16 * w), np.int64)
    for k, (_, v, _) in enumerate(kept):
        x[k, : len(v)] = v
    parts = x.reshape(len(x), 16, w)
    books = [parts[:64, p].copy() for p in range(16)]
    for k in range(rounds + 1):
        d = [((parts[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(16)]
        codes = [a.argmin(axis=1) for a in d]
        if k < rounds:
            for p in range(16):
                for e in range(len(books[p])):
                    if (own := parts[codes[p] == e, p]).size:
                        books[p][e] = own.sum(axis=0) // len(own)
    errors = sum(a.min(axis=1) for a in d)
    sums = {}
    for (_, _, label), e in zip(kept, errors.tolist(), strict=True):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), sums[label], digest)) for k, (i, _, label) in enumerate(kept))


def _run(spark, rows, tmp_path, parts=3):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(parts).write.parquet(f"{path}/embeddings.parquet")
    got = vc.op12_vector_codes(spark, path)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(repr(tuple(r)) for r in got.collect())


def _vectors(seed, n, width, spread):
    rng = random.Random(seed)
    centres = [[rng.uniform(-spread, spread) for _ in range(width)] for _ in range(9)]
    rows = []
    for i in range(n):
        v = [float(np.float32(c + rng.gauss(0, spread / 10))) for c in rng.choice(centres)]
        rows.append((i, v, rng.choice([None, 1, 2])))
    return rows + [(n, rows[0][1], 1)] * 40  # one vector many times, under one id


@pytest.mark.parametrize(("seed", "n", "width", "spread", "block"), [(1, 700, 32, 0.5, 1 << 19), (2, 300, 20, 0.02, 3000), (3, 120, 16, 40_000.0, 500), (4, 30, 48, 1.0, 1000)])
def test_codes_are_those_of_full_scans(spark, tmp_path, monkeypatch, seed, n, width, spread, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rows = _vectors(seed, n, width, spread)
    assert _run(spark, rows, tmp_path) == _brute(rows)


def test_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [None] * 16, 1), (3, [nan] + [0.0] * 15, 2), (4, [inf] * 16, None), (5, [-inf] * 16, None)]
    assert _run(spark, bad, tmp_path / "bad") == []
    assert _run(spark, [], tmp_path / "none") == []
    rows = [*bad, (None, [0.5] * 16, None), (7, [-0.001] * 16, None), (7, [-0.001] * 16, 3), (7, [0.25] * 16, 3), (9, [], 3), (10, [1.0] * 5, None)]
    assert _run(spark, rows, tmp_path / "some") == _brute(rows)
    huge = spark.createDataFrame([(1, [3e38] * 16, 1, "", 0, 0), (2, [-3e38] * 16, 1, "", 0, 0)], SCHEMA)
    assert [r.error for r in vc.codes(huge)[0].collect()] == [0, 0]


def test_decoded(spark):
    df = spark.createDataFrame([(i, [i / 4] * 32, 1, "", 0, 0) for i in range(10)], SCHEMA)
    found, books = vc.codes(df)
    for r in found.collect():
        assert r.error == 0 and vc.decoded(r.code, books).tolist() == [r.vec_id * 64] * 32


def test_heaps():
    rng = np.random.default_rng(1)
    heap, keys = rng.integers(0, 7, 500), rng.integers(0, 50, 500).astype(float)
    heaps = vc.Heaps.of(heap, keys, np.arange(500, dtype=np.int32), 9)
    held = dict(enumerate(zip(heap.tolist(), keys.tolist(), strict=True)))
    for _ in range(20):
        limits = rng.integers(-5, 30, 9).astype(float)
        popped = heaps.pop(limits)
        due = {m for m, (h, k) in held.items() if k <= limits[h]}
        assert sorted(heaps.members[popped].tolist()) == sorted(due)
        to, new = rng.integers(0, 9, len(popped)), rng.integers(0, 60, len(popped)).astype(float)
        for m, h, k in zip(heaps.members[popped].tolist(), to.tolist(), new.tolist(), strict=True):
            held[m] = (h, k)
        heaps = heaps.push(popped, to, new)
        own = np.repeat(np.arange(9), heaps.sizes)
        assert {m: x for m, *x in zip(heaps.members.tolist(), own.tolist(), heaps.keys.tolist(), strict=True)} == {m: list(x) for m, x in held.items()}
        for h in range(9):  # no member is less than the one above it
            k = heaps.keys[own == h]
            assert all(k[i] >= k[(i - 1) // 2] for i in range(1, len(k)))


def test_only_violated_parts_are_scanned(spark, monkeypatch):
    """Far groups don't move: nothing is popped after the first scan."""
    scans = []
    books = vc.Codebooks(np.array([[[0], [1000]]] * 16))
    x = np.array([[0] * 16, [1000] * 16, [2] * 16], np.int32)
    codes, slack = (np.stack(c, axis=1) for c in zip(*(vc.scanned_exactly(x.reshape(3, 16, 1)[:, p], books.books[p]) for p in range(16)), strict=True))
    heaps = vc.Heaps.of((np.arange(16) * 2 + codes).ravel(), slack.ravel(), np.arange(48, dtype=np.int32), 32)
    sums = vc._sums(x.reshape(3, 16, 1), codes, 2)
    after = books.moved(sums[:, :, 0], sums[:, :, 1:])
    assert after.books[0].tolist() == [[1], [1000]] and after.drift[0].tolist() == [1.0, 1.0]
    monkeypatch.setattr(vc, "scanned_exactly", lambda *a: scans.append(a))
    assert len(heaps.pop(after.drift.ravel() + vc.MARGIN)) == 0 and not scans
    assert len(heaps.pop(np.full(32, 997.0))) == 16  # the parts between the entries are the first to be violated
