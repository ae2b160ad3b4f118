"""The prefix trie against plain Python: every mechanism at small bounds, LOUDS round trips, edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scriptorium.llm import prefix_trie
from scriptorium.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string, place long, a long, shard string"


def _conversations(seed: int, n: int = 120):
    rng = random.Random(seed)
    rows, common = [], [("user", "hello there  all"), ("assistant", None), (None, "x y"), ("user", "")]
    trunk = [("user", f"t{i} {'w ' * (i % 3)}") for i in range(23)]
    for c in rng.sample(range(3 * n), n):
        kind = rng.random()
        if kind < 0.3:
            turns = list(common)
        elif kind < 0.6:
            turns = trunk[: rng.randint(1, 23)] + [(rng.choice(["user", "assistant"]), rng.choice(["a b", "c", None, "d e f"])) for _ in range(rng.randint(0, 3))]
        else:
            turns = [(rng.choice(["user", None]), rng.choice("abc")) for _ in range(rng.randint(1, 5))]
        numbers = [None, *range(1, len(turns))]
        rows += [(c, k, *t, 7, 8, "s") for k, t in zip(numbers, turns, strict=True)]
    rng.shuffle(rows)
    return rows


def _brute(rows, rebuild):
    own = defaultdict(list)
    for c, k, role, text, *_ in rows:
        if c is not None:
            own[c].append((k is not None, k, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    kids = defaultdict(list)
    for x in members:
        if x:
            kids[x[:-1]].append(x)
    words = lambda t: len([w for w in t.replace("\v", " ").split(" ") if w])
    out = {}
    for x in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids[x]]
        own_saved = (len(members[x]) - 1) * words(x[-1][1]) if x else 0
        sha = hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest()
        out[x] = (members[x][0], len(x), members[x[:-1]][0] if x else None, len(members[x]), len(kids[x]), sum(b[5] for b in below) or 1, own_saved + sum(b[6] for b in below), sha)
    return sorted(map(repr, out.values()))


@pytest.mark.parametrize(("seed", "rebuild", "band", "heavy", "rows", "members"), [(1, True, 64, 1024, None, 10_000), (2, True, 4, 3, 10, 5), (3, False, 3, 8, None, 2), (4, True, 1, 2, 6, 1)])
def test_nodes(spark, seed, rebuild, band, heavy, rows, members, monkeypatch):
    given = _conversations(seed)
    monkeypatch.setattr(prefix_trie, "FOREST", 50)
    got = prefix_trie.trie_nodes(spark.createDataFrame(given, SCHEMA), rebuild, band, heavy, rows, members)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for _, t in got.dtypes[:-1])
    assert sorted(repr(tuple(r)) for r in got.collect()) == _brute(given, rebuild)


def test_edges(spark):
    none = stored(spark.createDataFrame([], SCHEMA), "none")
    assert prefix_trie.trie_nodes(none, True).count() == 0 and prefix_trie.packed_tries(none).count() == 0
    only_null = spark.createDataFrame([(None, 1, "user", "x", 1, 2, "s")], SCHEMA)
    assert prefix_trie.trie_nodes(only_null, True).count() == 0
    # all turns of the one conversation are replaced by those of a block that isn't there: a root without turns
    c = next(c for c in range(21, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    bare = prefix_trie.trie_nodes(spark.createDataFrame([(c, 1, "user", "x", 1, 2, "s")], SCHEMA), True).collect()
    assert [tuple(r) for r in bare] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # repeated rows and equal numbers are turns of their own; long texts are read whole
    long = "word " * 400_000
    rows = [(1, 5, "user", long, 0, 0, "s")] * 2 + [(2, 5, "user", long, 0, 0, "s")] * 2
    got = {r.depth: r for r in prefix_trie.trie_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [0, 1, 2] and got[0].saved_tokens == 800_000 and got[2].ends_sha256 == hashlib.sha256(b"1,2").hexdigest()


def test_louds_of_a_random_trie():
    rng = np.random.default_rng(3)
    paths = [rng.integers(0, 3, rng.integers(1, 9)) for _ in range(300)]
    names = {p: i for i, p in enumerate(sorted({tuple(p[: k + 1]) for p in paths for k in range(len(p))}))}
    ids = np.concatenate([[names[tuple(p[: k + 1])] for k in range(len(p))] for p in paths])
    lens = np.array([len(p) for p in paths])
    trie, turns, _, _ = prefix_trie.build(np.cumsum(lens) - lens, lens, ids, ids, np.concatenate(paths))
    again = prefix_trie.Louds.packed(*trie.pack())
    assert (again.bits == trie.bits).all() and len(turns) == len(names)

    def prefix(k):
        return () if k == 0 else (*prefix(again.parents[k - 1]), int(again.labels[k - 1]))

    assert {prefix(k) for k in range(1, len(names) + 1)} == set(names)
    own = rng.integers(0, 100, len(names) + 1)
    want = own.copy()
    for k in range(len(names), 0, -1):
        want[again.parents[k - 1]] += want[k]
    assert (again.rolled(own) == want).all()


def test_packed_tries_hold_every_prefix(spark):
    given = _conversations(9)
    tries = [prefix_trie.Louds.packed(r.bits, r.labels) for r in prefix_trie.packed_tries(spark.createDataFrame(given, SCHEMA)).collect()]
    assert sum(len(t.labels) for t in tries) == len(_brute(given, False)) - 1
