"""Similarity of two texts.

The default is the matching-block ratio as Python's difflib defines it (not symmetric; gold comes first), as an Arrow UDF;
the edit ratio is JVM-side. Both have the same sound bound: the multiset of shared characters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Places, similarity


def ratio(a: Column | str, b: Column | str) -> Column:
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        places = lru_cache(maxsize=1_000)(Places)
        known = lru_cache(maxsize=100_000)(lambda p, q: similarity(p, places(q)))
        for x, y in batches:
            yield pa.array([known(p or "", q or "") for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(a, b)


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y).cast("double") / longest)


def bag(x: Column | str) -> Column:
    """The characters of a text as a set: each with its number among its equals. Later numbers come first, as they are rarer."""
    chars = F.array_sort(F.filter(F.split(F.col(x) if isinstance(x, str) else x, ""), lambda c: c != ""))
    numbered = F.transform(chars, lambda c, i: F.struct((-(i + 1 - F.array_position(chars, c))).alias("k"), c.alias("c")))
    return F.transform(F.array_sort(numbered), lambda s: F.concat(s["c"], s["k"].cast("string")))


#: Tokens that a key of with_keys holds together, by the size of the larger bag (up to), while there are enough of them.
TOGETHER = ((16, 3), (48, 2))


def _least_share(threshold: float) -> float:
    """The share of its own tokens that a bag must have in common with any other to reach the threshold."""
    return threshold / (2 - threshold)


def _sizes(threshold: float, together: Sequence[tuple[int, int]] = TOGETHER) -> list[tuple[int, int, int]]:
    """Ranges of sizes (from, to) of the larger of two bags, and how many common tokens a key holds there."""
    r, out = _least_share(threshold), []
    if not together:
        return [(1, 2**31 - 1, 1)]
    least = lambda n: math.ceil(r * n - 1e-9)
    top = together[-1][0]
    for m in range(1, top + 1):
        s = max(min(next(k for to, k in together if m <= to), least(least(m))), 1)  # what the smallest partner must share
        if out and out[-1][2] == s:
            out[-1] = (out[-1][0], m, s)
        else:
            out.append((m, m, s))
    return [*out, (top + 1, 2**31 - 1, 1)]


def _combined(p: Column, together: int) -> Column:
    """All choices of so many elements of an array, in its order, each as a text."""
    if together == 1:
        return p
    rest = lambda at: F.slice(p, at, F.size(p))
    mark = F.lit("\x1f")
    if together == 2:
        return F.flatten(F.transform(p, lambda x, i: F.transform(rest(i + 2), lambda y: F.concat(x, mark, y))))
    return F.flatten(F.transform(p, lambda x, i: F.flatten(F.transform(rest(i + 2), lambda y, j: F.transform(rest(i + j + 3), lambda z: F.concat(x, mark, y, mark, z))))))


def with_keys(df: DataFrame, tokens: str, threshold: float, together: Sequence[tuple[int, int]] = TOGETHER, name: str = "token") -> DataFrame:
    """A row for each key of the bag in column tokens: two texts that reach the threshold have one in common.

    Two bags that share c tokens share s of the first n - c + s of each. The size of the larger one decides how many
    tokens a key holds, so a text has keys for its own size and for all that may be its partner's."""
    n, r = F.size(tokens), _least_share(threshold)
    least = F.ceil(F.lit(r) * n - 1e-9).cast("int")
    ranges, out = _sizes(threshold, together), df
    for k, (lo, hi, s) in enumerate(ranges):
        meets = (n > 0) & (n <= hi) & (F.floor(n / F.lit(r) + 1e-9) >= lo)
        out = out.withColumn(f"_p{k}", F.when(meets, F.slice(tokens, 1, F.greatest(n - least + s, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    marked = lambda of, k: F.transform(of, lambda x: F.concat(F.lit(f"{k}:"), x))
    keys = [marked(_combined(F.col(f"_p{k}"), s), k) for k, (_, _, s) in enumerate(ranges)]
    empty = F.when(n == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return out.withColumn(name, F.explode(F.concat(empty, *keys))).drop(*(f"_p{k}" for k in range(len(ranges))))


def _edits(n: Column, threshold: float) -> Column:
    """Edits that a pair of texts allows whose longer one has n characters."""
    return F.floor(F.lit(1 - threshold) * n + 1e-9).cast("int")


def within_edits(a: str, b: str, threshold: float) -> Column:
    """Whether the edit ratio of two columns may reach the threshold, by a distance that ends where too many edits are made."""
    return F.call_function("levenshtein", F.col(a), F.col(b), _edits(F.greatest(F.length(a), F.length(b)), threshold)) >= 0


def may_reach(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Whether two bags allow the threshold."""
    total = F.size(a) + F.size(b)
    return (total == 0) | (2 * F.size(F.array_intersect(a, b)) >= threshold * total - 1e-9)
