"""Edit scripts and matching blocks by bits against the plain tables they stand for, and against difflib."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.functions import blocks, edits

TEXT = st.one_of(st.text("ab", max_size=40), st.text("abcdé ", max_size=60), st.lists(st.sampled_from(["a", "bb", "c d"]), max_size=25))


def _table(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows


def _script(gold, extracted):
    """From the end: deletion, else match or substitution, else insertion; common ends are left out first."""
    lead = 0
    while lead < min(len(gold), len(extracted)) and gold[lead] == extracted[lead]:
        lead += 1
    tail = 0
    while tail < min(len(gold), len(extracted)) - lead and gold[-1 - tail] == extracted[-1 - tail]:
        tail += 1
    a, b = gold[lead : len(gold) - tail], extracted[lead : len(extracted) - tail]
    d, i, j, out = _table(a, b), len(a), len(b), []
    while i or j:
        if i and d[i - 1][j] + 1 == d[i][j]:
            i -= 1
            out.append(("deletion", a[i], "", lead + i))
        elif i and j and d[i - 1][j - 1] + (a[i - 1] != b[j - 1]) == d[i][j]:
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append(("substitution", a[i], b[j], lead + i))
        else:
            j -= 1
            out.append(("insertion", "", b[j], lead + j))
    return out[::-1]


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.sampled_from([0, 64, 1 << 24]))
def test_scripts(a, b, held):
    if type(a) is not type(b):
        b = list(b) if isinstance(a, list) else "".join(b)
    before, edits.HELD = edits.HELD, held
    try:
        got = edits.edit_script(a, b)
    finally:
        edits.HELD = before
    assert got == _script(a, b) and edits.edit_distance(a, b) == len(got) == _table(a, b)[-1][-1]


def _noisy(rng, text, letters, share):
    return "".join(c if rng.random() > share else rng.choice([rng.choice(letters), "", c + c]) for c in text)


@pytest.mark.parametrize("size", [300, 3_000])
def test_long_scripts(size, monkeypatch):
    rng = random.Random(size)
    a = "".join(rng.choices("abcdefgh ", k=size))
    b = _noisy(rng, a, "abcxyz", 0.1)
    want = edits.edit_script(a, b)
    monkeypatch.setattr(edits, "HELD", 1_000)
    assert edits.edit_script(a, b) == want
    if size < 1_000:
        assert want == _script(a, b)


def _merged(found):
    out = []
    for i, j, n in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return out


def _difflib(a, b):
    return [tuple(x) for x in SequenceMatcher(None, a, b).get_matching_blocks() if x.size]


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_blocks(a, b):
    if type(a) is not type(b):
        b = list(b) if isinstance(a, list) else "".join(b)
    assert _merged(blocks.matching_blocks(a, b)) == _difflib(a, b)
    assert blocks.similarity(a, b) == SequenceMatcher(None, a, b).ratio()
    want = [x[1:] for x in SequenceMatcher(None, a, b).get_opcodes() if x[0] != "equal"]
    assert blocks.gaps(a, b) == want


@pytest.mark.parametrize("size", [1, 50, 199, 200, 201, 350, 1_000, 5_000])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "".join(map(chr, range(0x400, 0x500)))])
def test_long_blocks(size, letters):
    """Popular elements from 200 on: with two letters all are, with 256 none."""
    rng = random.Random(size + len(letters))
    a = "".join(rng.choices(letters, weights=[1 / (k + 1) for k in range(len(letters))], k=size))
    for b in (_noisy(rng, a, letters, 0.08), "".join(rng.choices(letters, k=size))):
        assert _merged(blocks.matching_blocks(a, b)) == _difflib(a, b)


def test_word_distance_of_many_distinct_words(spark):
    """More distinct words than there are characters."""
    n = 1_200_000
    a = " ".join(map(str, range(n)))
    df = spark.createDataFrame([(a, a.replace(" 7 ", " x "), 1), ("a b", "a", 1), (None, "a", 1)], "g string, e string, k int")
    assert [r.d for r in df.select(edits.word_distance("g", "e").alias("d")).collect()] == [1, 1, 1]
