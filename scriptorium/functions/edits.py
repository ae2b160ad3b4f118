"""Edit distances and scripts.

Totals use the built-in distance. Scripts (which characters or words were replaced, dropped, added) come from an Arrow
UDF that aligns from the end, preferring deletion to match or substitution to insertion. A row of the alignment table is
a pair of whole numbers whose bits are the differences between neighbouring cells, so a step takes all columns at once.
Long texts keep some rows and make the others again, so memory grows with a text's length to the power of 1.5, in bits."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EDIT
from .blocks import gaps
from .text import tokens

#: Bits of an alignment table that is held whole.
HELD = 1 << 24
#: Characters up to which the built-in distance is the quicker one.
SHORT = 64
#: Edits that are handed over together, about.
AT_A_TIME = 100_000


class _Rows:
    """The alignment table of a (rows) against b (columns), by the differences of its cells."""

    def __init__(self, a: Sequence, b: Sequence) -> None:
        self.a, self.width = a, len(b)
        self.mask = (1 << len(b)) - 1
        self.places: dict = {}
        bit = 1
        for x in b:
            self.places[x] = self.places.get(x, 0) | bit
            bit <<= 1

    def steps(self, first: int, last: int, up: int, down: int) -> Iterator[tuple[int, int, int, int]]:
        """For each row from first + 1 to last: the columns where it is one more and one less than the row before, where it
        equals its upper left neighbour, and (as up and down) where it rises and falls from left to right."""
        get, mask = self.places.get, self.mask
        for x in self.a[first:last]:
            same = get(x, 0)
            level = (((same & up) + up) ^ up | same | down) & mask
            more, less = down | mask & ~(level | up), level & up
            shifted = more << 1 | 1
            down = level & shifted & mask
            up = (less << 1 | ~(level | shifted)) & mask
            yield more, level, up, down

    def distance(self) -> int:
        if not self.width:
            return len(self.a)
        top, total, up, down = 1 << (self.width - 1), self.width, self.mask, 0
        for more, level, up_, down in self.steps(0, len(self.a), up, down):
            # less stands where the row before rose and the level is kept
            total += 1 if more & top else -1 if level & up & top else 0
            up = up_
        return total


def _backwards(rows: _Rows) -> Iterator[tuple[int, int]]:
    """(more, level) of each row, from the last to the first."""
    n = len(rows.a)
    if 2 * n * rows.width <= HELD:
        yield from reversed([(more, level) for more, level, _, _ in rows.steps(0, n, rows.mask, 0)])
        return
    step = math.isqrt(n) + 1
    kept = [(rows.mask, 0)]
    for i, (_, _, up, down) in enumerate(rows.steps(0, n, rows.mask, 0), 1):
        if i % step == 0:
            kept.append((up, down))
    for at in range((n - 1) // step, -1, -1):
        yield from reversed([(more, level) for more, level, _, _ in rows.steps(at * step, min((at + 1) * step, n), *kept[at])])


def _common_ends(gold: Sequence, extracted: Sequence) -> tuple[int, int]:
    """How many elements both have in common at the beginning, and of the rest at the end."""
    least = min(len(gold), len(extracted))
    lead = next((k for k in range(least) if gold[k] != extracted[k]), least)
    return lead, next((k for k in range(least - lead) if gold[-1 - k] != extracted[-1 - k]), least - lead)


def edit_script(gold: Sequence, extracted: Sequence) -> list[tuple[str, str, str, int]]:
    """(op, gold character, extracted character, position) from left to right; of words, if these are lists of words."""
    lead, tail = _common_ends(gold, extracted)
    a, b = gold[lead : len(gold) - tail], extracted[lead : len(extracted) - tail]
    j, out = len(b), []
    for i, (more, level) in zip(range(len(a) - 1, -1, -1), _backwards(_Rows(a, b)) if b else ((0, 0) for _ in a), strict=True):
        x = a[i]
        while True:
            if not j or more >> (j - 1) & 1:
                out.append(("deletion", x, "", lead + i))
                break
            if x == b[j - 1]:
                j -= 1
                break
            if not level >> (j - 1) & 1:
                j -= 1
                out.append(("substitution", x, b[j], lead + i))
                break
            j -= 1
            out.append(("insertion", "", b[j], lead + j))
    out += [("insertion", "", b[k], lead + k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def edit_distance(gold: Sequence, extracted: Sequence) -> int:
    """The number of edits; of words, if these are lists of words."""
    lead, tail = _common_ends(gold, extracted)
    return _Rows(gold[lead : len(gold) - tail], extracted[lead : len(extracted) - tail]).distance()


def block_script(gold: str, extracted: str) -> list[tuple[str, str, str, int]]:
    """The script of matching blocks: replaced stretches are paired from the left. Not the shortest one."""
    out = []
    for i, i2, j, j2 in gaps(gold, extracted):
        both = min(i2 - i, j2 - j)
        out += [("substitution", gold[i + k], extracted[j + k], i + k) for k in range(both)]
        out += [("deletion", gold[k], "", k) for k in range(i + both, i2)]
        out += [("insertion", "", extracted[k], k) for k in range(j + both, j2)]
    return out


def edit_ops(gold: Column | str, extracted: Column | str, mode: str = "shortest") -> Column:
    """mode: shortest, or blocks."""
    script = {"shortest": edit_script, "blocks": block_script}[mode]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield from _listed(script(p.as_py() or "", q.as_py() or "") for p, q in zip(x, y, strict=True))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, EDIT)(gold, extracted)


def _listed(scripts: Iterable[list[tuple[str, str, str, int]]]) -> Iterator[pa.Array]:
    """Scripts as columns, a piece whenever it has AT_A_TIME edits, so that no batch of rows is held as edits."""
    fields = (("op", pa.string()), ("gt", pa.string()), ("ext", pa.string()), ("pos", pa.int32()))
    columns, ends = ([], [], [], []), [0]

    def made() -> pa.Array:
        parts = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

    for edits in scripts:
        for c, values in zip(columns, zip(*edits, strict=True), strict=False):
            c.extend(values)
        ends.append(len(columns[0]))
        if ends[-1] >= AT_A_TIME:
            yield made()
            columns, ends = ([], [], [], []), [0]
    if len(ends) > 1:
        yield made()


def char_distance(gold: str, extracted: str) -> Column:
    """The edit distance of two columns by characters: the built-in one, whose steps are all cells of the table, up to SHORT."""
    long = F.greatest(F.length(gold), F.length(extracted)) > SHORT

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([None if p is None or q is None else edit_distance(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    far = F.arrow_udf(run, "int")(F.when(long, F.col(gold)), F.when(long, F.col(extracted)))
    return F.when(long, far).otherwise(F.levenshtein(gold, extracted))


def word_distance(gold: Column | str, extracted: Column | str) -> Column:
    """The edit distance of two texts by words."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([edit_distance(p or [], q or []) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "int")(tokens(gold), tokens(extracted))


WORD_OPS = ("substitutions", "deletions", "insertions")


def _counted_ops(gold: list[str], extracted: list[str], mode: str) -> tuple[int, ...]:
    """Words replaced, dropped, added. blocks: as difflib's matching blocks have it, a replaced stretch counting as its longer side."""
    if mode == "shortest":
        ops = [o[0] for o in edit_script(gold, extracted)]
        return ops.count("substitution"), ops.count("deletion"), ops.count("insertion")
    n = [0, 0, 0]
    for i, i2, j, j2 in gaps(gold, extracted):
        n[0 if i < i2 and j < j2 else 1 if i < i2 else 2] += max(i2 - i, j2 - j)
    return tuple(n)


def word_ops(gold: Column | str, extracted: Column | str, mode: str = "shortest") -> Column:
    """A struct of the numbers of words replaced, dropped and added. mode: shortest, or blocks."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x, y in batches:
            rows = [_counted_ops(p or [], q or [], mode) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], list(WORD_OPS))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ", ".join(f"{c} long" for c in WORD_OPS))(tokens(gold), tokens(extracted))
