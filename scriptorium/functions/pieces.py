"""Keys and bounds for pairs of texts within a number of edits, on arrays of texts of one length.

A text that allows k edits is cut into k + 1 pieces, half of them counted from its start and half from its end. One piece at
least stands in the other text unchanged, moved by no more places than there are pieces before it on its side: else each
piece of a side would have brought an edit more, and all together more than k."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Keys, pairs or letters that are held at once, about.
AT_ONCE = 250_000
#: Pairs of two blocks from which they are compared as a table, not pair by pair.
TABLE = 1_024


def edits_of(n: int, threshold: float) -> int:
    """Edits that a pair of texts allows whose longer one has n characters."""
    return math.floor((1 - threshold) * n + 1e-9)


def _fit(n: int, m: int, threshold: float) -> bool:
    return abs(n - m) <= edits_of(max(n, m), threshold)


def cut(n: int, others: Sequence[int], threshold: float) -> list[tuple[int, int, int, int]]:
    """The pieces of a text of n characters whose partners have lengths others: side (0: from the start), places before, length, reach.

    Letters left over go to the pieces that may move most."""
    allowed = [edits_of(max(n, m), threshold) for m in others if _fit(n, m, threshold)]
    if not allowed:
        return []
    p = max(allowed) + 1
    order = sorted(((i, side) for side, count in ((0, (p + 1) // 2), (1, p // 2)) for i in range(count)), reverse=True)
    sizes = {piece: n // p + (k < n % p) for k, piece in enumerate(order)}
    return [(side, sum(sizes[j, side] for j in range(i)), sizes[i, side], i) for i, side in sorted(order)]


def own_keys(n: int, others: Sequence[int], threshold: float) -> list[tuple[int, int, int, int]]:
    """The keys of a text of n characters that is cut, one for each place that a piece may have: side, that place, own place from the start, length."""
    at = lambda side, start, size: start if side == 0 else n - start - size
    return [(side, start + s, at(side, start, size), size) for side, start, size, reach in cut(n, others, threshold) for s in range(-reach, reach + 1) if start + s >= 0]


def asked_keys(m: int, others: Sequence[int], lengths: Sequence[int], threshold: float) -> list[tuple[int, int, int, int]]:
    """The keys of a text of m characters, one of lengths, that texts of the lengths others ask for when they are cut."""
    asked = {(side, place, size) for n in others if _fit(n, m, threshold) for side, place, _, size in own_keys(n, lengths, threshold)}
    return [(side, place, place if side == 0 else m - place - size, size) for side, place, size in sorted(asked) if place + size <= m]


def letters(texts: pa.Array, n: int) -> np.ndarray:
    """Texts of n characters as rows of code points; straight from their bytes, where these are as many."""
    if n and texts.type == pa.string() and len(texts):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] - offsets[0] == n * len(texts):
            return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, n)
    return np.array(texts.to_pylist(), f"U{max(n, 1)}").view(np.uint32).reshape(len(texts), max(n, 1))[:, :n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(codes: np.ndarray, asked: Sequence[tuple[int, int, int, int]]) -> Iterator[np.ndarray]:
    """For each key asked for, its values for all rows."""
    for side, place, at, size in asked:
        h = np.full(len(codes), (place * 2 + side) * 0x1_0000_0001 + size, np.uint64)
        for j in range(at, at + size):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, j] + np.uint64(1))
        yield _mixed(h).view(np.int64)


def zones(codes: np.ndarray, h: int, kinds: np.ndarray) -> np.ndarray:
    """Which kinds of letters the first h and the last h places have, and which twice, in 64 bits. kinds: of each code point, one of 16 bits.

    An edit changes two bits at most: one letter for another, or one in and one over the edge."""
    out = np.zeros(len(codes), np.uint64)
    for k, own in enumerate((codes[:, :h], codes[:, codes.shape[1] - h :])):
        once, twice = np.zeros((2, len(codes)), np.uint64)
        for j in range(h):
            bit = kinds[own[:, j]]
            twice |= once & bit
            once |= bit
        out |= (once | twice << np.uint64(16)) << np.uint64(32 * k)
    return out


def near(g: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """Whether two rows of letters may be k edits apart: all but k letters of the first have an equal where they may have moved to.

    A letter that moves by s places has that many edits before it, and after it what is left to the difference of the lengths."""
    m, n = g.shape[1], e.shape[1]
    g, e = np.ascontiguousarray(g.T), np.ascontiguousarray(e.T)
    moves = [s for s in range(-k, k + 1) if abs(s) + abs(n - m - s) <= k]
    lost = np.zeros(g.shape[1], np.int32)
    for i in range(m):
        found = np.zeros(g.shape[1], bool)
        for s in moves:
            if 0 <= i + s < n:
                found |= g[i] == e[i + s]
        lost += ~found
    return lost <= k


def near_pairs(g_texts: pa.ListArray, e_texts: pa.ListArray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of texts from two lists in the same row that may reach the threshold: row, and places in the flat lists."""
    sides = []
    for lists in (g_texts, e_texts):
        texts = lists.flatten()
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        own = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        sides.append((rows, own, {n: letters(texts.take(pa.array(at)), n) for n, at in own.items()}))
    (g_rows, g_own, g_codes), (e_rows, e_own, e_codes) = sides
    found = np.unique(np.concatenate([np.zeros(1, np.uint32), *(np.unique(c) for s in sides for c in s[2].values())]))
    kinds = np.zeros(int(found[-1]) + 1, np.uint64)
    kinds[found] = np.uint64(1) << (np.arange(len(found)) % 16).astype(np.uint64)
    signs: dict = {}

    def signed(side: int, n: int, h: int) -> np.ndarray:
        if (side, n, h) not in signs:
            signs[side, n, h] = zones(sides[side][2][n], h, kinds)
        return signs[side, n, h]

    for m in g_own:
        for n in e_own:
            if not _fit(m, n, threshold):
                continue
            k, h = edits_of(max(m, n), threshold), min(m, n) // 2
            step = max(AT_ONCE // max(m, n, 1), 1)
            for i, j in _together(_alike(g_rows[g_own[m]], e_rows[e_own[n]], signed(0, m, h), signed(1, n, h), 2 * k), step):
                kept = near(g_codes[m][i], e_codes[n][j], k)
                p, q = g_own[m][i[kept]], e_own[n][j[kept]]
                if len(p):
                    yield g_rows[p], p, q


def _together(pieces: Iterator[tuple[np.ndarray, np.ndarray]], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays put together or cut, to about so many elements each."""
    held, n = [], 0
    for piece in chain(pieces, [None]):
        if piece is not None and len(piece[0]):
            held.append(piece)
            n += len(piece[0])
        if held and (piece is None or n >= step):
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
            for at in range(0, len(i), step):
                yield i[at : at + step], j[at : at + step]


def _alike(g_rows: np.ndarray, e_rows: np.ndarray, g_signs: np.ndarray, e_signs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of elements of one row (both sides by rows, ascending) whose signs differ in no more than so many bits."""
    start, end = np.searchsorted(e_rows, g_rows, "left"), np.searchsorted(e_rows, g_rows, "right")
    partners = end - start
    first = np.flatnonzero(np.diff(g_rows, prepend=-1))
    count = np.diff(first, append=len(g_rows))
    large = count * partners[first] >= TABLE
    for a, c in zip(first[large], count[large], strict=True):
        lo, hi = start[a], end[a]
        step = max(AT_ONCE // (hi - lo), 1)
        for at in range(a, a + c, step):
            top = min(at + step, a + c)
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(g_signs[at:top, None] ^ e_signs[None, lo:hi]) <= most), hi - lo)
            yield i + at, j + lo
    single = np.flatnonzero(~np.repeat(large, count) & (partners > 0))
    ends = np.cumsum(partners[single])
    for own in np.split(single, np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE))) if len(single) else []:
        each = partners[own]
        i = np.repeat(own, each)
        j = np.repeat(start[own] - np.cumsum(each) + each, each) + np.arange(each.sum())
        kept = np.bitwise_count(g_signs[i] ^ e_signs[j]) <= most
        yield i[kept], j[kept]
