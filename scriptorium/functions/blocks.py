"""Matching blocks of two sequences: the longest common run (the earliest in the first one, then in the second), then the
same left and right of it, as Python's difflib defines them.

A run of length k that ends at element i of the first sequence is a bit at its end in the second one; k is doubled and
then refined on sets of such bits, for all ends at once. From POPULAR elements on, those that make up more than a
hundredth of the second sequence don't begin a run, but prolong one."""

from __future__ import annotations

from collections.abc import Sequence

#: Elements of the second sequence from which popular ones are told apart.
POPULAR = 200


class Places:
    """Where the elements of b stand, as bits; may be used with any number of other sequences."""

    def __init__(self, b: Sequence) -> None:
        self.b, self.bits = b, {}
        bit = 1
        for x in b:
            self.bits[x] = self.bits.get(x, 0) | bit
            bit <<= 1
        if len(b) >= POPULAR:
            most = len(b) // 100 + 1
            self.bits = {x: m for x, m in self.bits.items() if m.bit_count() <= most}


def _longest(rows: dict[int, int]) -> tuple[int, int, int]:
    """rows: the places in b of each element of a that has any. (start in a, start in b, length) of the longest run."""
    powers, now, k = [], rows, 1
    while now:
        powers.append(now)
        now = {i: r for i, s in now.items() if (t := now.get(i - k)) and (r := s & (t << k))}
        k *= 2
    now, length = powers[-1], 1 << (len(powers) - 1)
    for p in range(len(powers) - 2, -1, -1):
        before = powers[p]
        if more := {i: r for i, s in now.items() if (t := before.get(i - length)) and (r := s & (t << length))}:
            now, length = more, length + (1 << p)
    i = min(now)
    s = now[i]
    return i - length + 1, (s & -s).bit_length() - length, length


def matching_blocks(a: Sequence, b: Sequence | Places) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) in order. Blocks may touch each other."""
    places = b if isinstance(b, Places) else Places(b)
    b, bits = places.b, places.bits
    of = [bits.get(x, 0) for x in a]
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        keep = (1 << (bhi - blo)) - 1
        rows = {i: r for i in range(alo, ahi) if (m := of[i]) and (r := (m >> blo) & keep)}
        i, j, n = _longest(rows) if rows else (alo, 0, 0)
        j += blo
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        if n:
            out.append((i, j, n))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi))
    return sorted(out)


def gaps(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """What stands between the matching blocks: (from, to) in a, (from, to) in b."""
    out, i, j = [], 0, 0
    for i2, j2, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < i2 or j < j2:
            out.append((i, i2, j, j2))
        i, j = i2 + n, j2 + n
    return out


def similarity(a: Sequence, b: Sequence | Places) -> float:
    """1 for two empty texts, 0 if one is, else twice the share of what blocks cover."""
    total = len(a) + len(b.b if isinstance(b, Places) else b)
    return 2.0 * sum(n for *_, n in matching_blocks(a, b)) / total if total else 1.0
