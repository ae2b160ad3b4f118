"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD) per language and source.

Method: each text that passes the base rules gives a vector of transformed statistics (FEATURES), in fixed point.
Cells are (language, source) pairs; those with fewer than LEAST texts are judged by all texts of their language, or else
of the table. Per cell the estimate starts from several deterministic scatter matrices, all about the medians: median
absolute deviations alone, correlations of tanh scores, and of spatial signs. From each, concentration steps follow: the SHARE of
texts with the least Mahalanobis distances gives the next mean and covariance. After TRIED steps the one of least
determinant goes on alone, until the logarithm of its determinant falls by less than TOLERANCE (STEPS at most). No direction of a covariance is less wide than the features' least
deviations allow, as many statistics are mostly zero. A text is rejected if its distance from its cell's estimate, scaled
for consistency, exceeds the CUT quantile of the chi-square distribution.

Everything is counted over all rows: quantiles and moments are exact sums of integers over small rows, aggregated
partially before any shuffle, so a hot source costs a few rows for each task and results don't depend on partitioning.

Defined cases: a null or wordless text has zero counts and fails the base rules. Null lang or source is a value of
its own. Repeated rows count each. If fewer than LEAST texts pass in all of the table, texts are kept. A feature counts
as MOST at most (symbols beyond 961 a word make no difference). An empty table gives an empty result. Texts of any
length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, table

#: Transformed statistics, and the least standard deviation of each.
FEATURES = (("log_words", 0.5), ("log_word_length", 0.05), ("symbols", 0.08), ("dup_lines", 0.15), ("repeats", 0.10))
LEAST = 100
SHARE = 0.75
TRIED, STEPS, TOLERANCE = 2, 30, 1e-3
#: The greatest value of a feature, far beyond any usual one, so that sums of products can't overflow.
MOST = 31
CUT = 0.99999
#: Fixed point: units of a feature, and steps of the logarithm of a squared distance.
UNIT, FINE = 1024, 256
SYMBOLS = "#*$%&|<>"
P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SPACES = b" \t\n\x0b\x0c\r"


def statistics(text: bytes | None) -> tuple[int, ...]:
    """Counts of STATS. n_lines: lines with a word."""
    words = text.split() if text else []  # bytes split at ASCII white space
    if not words:
        return 0, 0, sum(text.count(c) for c in SYMBOLS.encode()) if text else 0, 0, 0, 0
    whole = text.decode("utf-8", "replace")
    chars = len(whole) - sum(text.count(c) for c in _SPACES)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    repeated = 0
    if len(words) > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(seen := set(grams)) < len(grams):
            often = Counter(grams)
            to = 0
            for i, g in enumerate(grams):
                if often[g] > 1:
                    repeated += i + 3 - max(i, to)
                    to = i + 3
        del seen
    return len(words), chars, sum(text.count(c) for c in SYMBOLS.encode()), len(lines) - len(set(lines)), repeated, len(lines)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and STATS of the text. No shuffle; only the text crosses to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for column in batches:
            got = np.array([statistics(t) for _, part in slices(column) for t in part], np.int64).reshape(-1, len(names))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(names))], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.arrow_udf(run, STATS)("text").alias("_s")).select(*(F.col(f"`{c}`") for c in keep), "_s.*")


def _features() -> list[Column]:
    w = F.col("n_words")
    values = (F.log1p(w.cast("double")), F.log(F.col("word_chars") / w), F.sqrt(F.col("n_symbols") / w), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.col("n_repeat_words") / w)
    return [F.round(F.least(v, F.lit(float(MOST))) * UNIT).cast("long").alias(f"x{k}") for k, v in enumerate(values)]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
    n = 1
    while term > 1e-17 * total:
        term *= x / (a + n)
        total += term
        n += 1
    return min(total, 1.0)


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float = SHARE, p: int = P) -> float:
    """What the covariance of the central share of normal data is to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


_FLOORS = np.array([f for _, f in FEATURES])


def _symmetric(products: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, products, strict=True):
        out[i, j] = out[j, i] = v
    return out


def floored(cov: np.ndarray) -> np.ndarray:
    """cov, but no direction (with the features in units of their least deviations) has a variance under 1."""
    values, vectors = np.linalg.eigh(cov / np.outer(_FLOORS, _FLOORS))
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * np.outer(_FLOORS, _FLOORS)


def estimate(n: int, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance (in feature units) and the logarithm of its determinant, from sums and upper-triangle sums of products in fixed point."""
    mean = sums / n / UNIT
    cov = floored((_symmetric(products) / n / UNIT**2 - np.outer(mean, mean)) * consistency())
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


_MODEL = ", ".join([f"m{k} double" for k in range(P)] + [f"p{i}_{j} double" for i, j in _PAIRS])
_SUMS = [f"s{k}" for k in range(P)] + [f"c{i}_{j}" for i, j in _PAIRS]
_MODELS = f"cell string, start long, was double, det double, {_MODEL}"
_NAMES = [x.split()[0] for x in _MODELS.split(", ")]


def _made(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def _columns(mean: np.ndarray, inv: np.ndarray) -> list[float]:
    return [*mean.tolist(), *(float(inv[i, j]) for i, j in _PAIRS)]


def starts(n: int, mid: np.ndarray, scale: np.ndarray, tanh: np.ndarray, sign: np.ndarray) -> list[np.ndarray]:
    """The inverses of the scatter matrices that the steps start from. scale: deviations; tanh: sums and products of tanh
    scores, and sign: products of spatial signs, in fixed point."""
    out = [np.eye(P)]
    mean = tanh[:P] / n
    cov = _symmetric(tanh[P:] / n) - np.outer(mean, mean)
    wide = np.sqrt(np.maximum(np.diag(cov), 1.0))
    out.append(cov / np.outer(wide, wide) + np.diag(1.0 - np.diag(cov) / wide**2))
    out.append(_symmetric(sign / n) / UNIT**2 * P)
    return [np.linalg.inv(floored(x * np.outer(scale, scale))) for x in out]


def _first_models(base: DataFrame) -> DataFrame:
    """base: cell, n, mid*, scale*, x*. Per cell and start, mean and inverse covariance."""
    z = [(F.col(f"x{k}") - F.col(f"mid{k}")) / F.col(f"scale{k}") for k in range(P)]
    far = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    t = [F.round(F.tanh(v) * UNIT).cast("long").alias(f"t{k}") for k, v in enumerate(z)]
    u = [F.when(far > 0, F.round(v / far * UNIT)).otherwise(0).cast("long").alias(f"u{k}") for k, v in enumerate(z)]
    keep = [f"{c}{k}" for c in ("mid", "scale") for k in range(P)]
    product = lambda c, i, j: F.sum(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}_{j}")
    sums = base.select("cell", "n", *keep, *t, *u).groupBy("cell").agg(
        F.first("n").alias("n"), *(F.first(c).alias(c) for c in keep), *(F.sum(f"t{k}").alias(f"t{k}") for k in range(P)), *(product("t", i, j) for i, j in _PAIRS), *(product("u", i, j) for i, j in _PAIRS)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cell, n, *v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = np.array(v, float)
                mid, scale, tanh, sign = np.split(v, [P, 2 * P, 3 * P + len(_PAIRS)])
                rows += [(cell, k, math.inf, math.inf, *_columns(mid / UNIT, inv)) for k, inv in enumerate(starts(n, mid, scale / UNIT, tanh, sign))]
            if rows:
                yield _made(rows, _NAMES)

    return sums.mapInArrow(run, _MODELS)


def _models(moments: DataFrame) -> DataFrame:
    """Per cell and start, mean, inverse covariance, and the logarithm of the determinant, now and before (was)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cell, start, was, n, *v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mean, inv, det = estimate(n, np.array(v[:P], float), np.array(v[P:], float))
                rows.append((cell, start, was, det, *_columns(mean, inv)))
            if rows:
                yield _made(rows, _NAMES)

    return moments.select("cell", "start", "was", "n", *_SUMS).mapInArrow(run, _MODELS)


def _distance() -> Column:
    d = [F.col(f"x{k}") / UNIT - F.col(f"m{k}") for k in range(P)]
    return sum((d[i] * d[j] * F.col(f"p{i}_{j}") * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _grade(d2: Column) -> Column:
    """A squared distance as a whole number, in steps of its logarithm."""
    return F.floor(F.log2(1 + F.greatest(d2, F.lit(0.0))) * FINE).cast("long")


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """For each cell and start of model the estimate from the SHARE of rows nearest to it (all of the last grade).

    One pass: moments by grade, of which a cell has a few thousand, then those up to the share."""
    near = rows.join(model.drop("was").withColumnRenamed("det", "was"), "cell").withColumn("g", _grade(_distance()))
    sums = [F.sum(f"x{k}").alias(f"s{k}") for k in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in _PAIRS]
    by = near.groupBy("cell", "start", "was", "g").agg(F.count(F.lit(1)).alias("n"), *sums)
    own = Window.partitionBy("cell", "start", "was")
    by = by.withColumn("before", F.sum("n").over(own.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("all", F.sum("n").over(own))
    kept = by.where(F.col("before") < F.ceil(F.col("all") * SHARE)).groupBy("cell", "start", "was").agg(*(F.sum(c).alias(c) for c in ("n", *_SUMS)))
    return stored(_models(kept), "mcd")


def mcd(rows: DataFrame, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """rows: cell, x0.. (fixed point). Robust estimates of each cell with at least so many rows: columns of _MODELS.

    What is kept of a cell are small rows; Spark sees the size of these tables and picks the join."""
    xs = [f"x{k}" for k in range(P)]
    mid = stored(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"percentile({x}, 0.5)").alias(f"mid{k}") for k, x in enumerate(xs))).where(F.col("n") >= least), "mcd-mid")
    off = rows.join(mid, "cell")
    scale = lambda k, x: F.greatest(F.expr(f"percentile(abs({x} - mid{k}), 0.5)") * 1.4826, F.lit(UNIT * FEATURES[k][1]))
    mad = stored(off.groupBy("cell").agg(*(scale(k, x).alias(f"scale{k}") for k, x in enumerate(xs))), "mcd-mad")
    model = stored(_first_models(off.join(mad, "cell")), "mcd")
    for _ in range(TRIED):
        model = _step(rows, model)
    best = model.groupBy("cell").agg(F.min(F.struct("det", *(c for c in _NAMES if c not in ("cell", "det")))).alias("b"))
    model, found = stored(best.select("cell", "b.*").select(_NAMES), "mcd-best"), []
    moves = F.col("was") - F.col("det") >= TOLERANCE
    for _ in range(steps - TRIED):
        if (open_ := model.where(moves)).isEmpty():
            break
        found.append(model.where(~moves))
        model = _step(rows, open_)
    for df in found:
        model = model.unionByName(df)
    return model


def quality(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """docs: doc_id, text, lang, source. A row for each: doc_id, statistics, base_failed, distance2 (null without estimate), kept."""
    stats = with_statistics(docs, ["doc_id", "lang", "source"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed), "statistics")
    # a cell's name: JSON keeps null and text apart
    pair, lang = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang"))
    passed = stats.where("NOT base_failed").withColumn("pair", pair)
    size = passed.groupBy("pair", "lang").agg(F.count(F.lit(1)).alias("n"))
    # a pair with too few rows is judged by all rows of its language, or else by all rows of the table
    by_lang = size.groupBy(lang.alias("own")).agg(F.sum("n").alias("m"))
    cells = size.withColumn("own", lang).join(by_lang, "own", "left")
    cells = stored(cells.withColumn("cell", F.when(F.col("n") >= LEAST, F.col("pair")).when(F.col("m") >= LEAST, F.col("own")).otherwise("all")), "cells")
    asked = [F.lit(r.cell) for r in cells.where("cell = 'all'").select("cell").limit(1).collect()]
    langs = cells.where("cell = own").select("own", F.lit(True).alias("asked")).distinct()
    feeds = cells.join(langs, "own", "left")
    to = F.array_compact(F.array(F.when(F.col("n") >= LEAST, F.col("pair")), F.when(F.col("asked"), F.col("own")), *asked))
    feeds = stored(feeds.select("pair", F.explode(to).alias("cell")), "feeds")
    rows = stored(passed.join(feeds, "pair").select("cell", *_features()), "vectors")
    model = mcd(rows).drop("start", "was", "det")
    named = cells.select("pair", "cell").join(model, "cell", "left")
    at = stats.withColumn("pair", F.when(~F.col("base_failed"), pair)).select("*", *(F.when(~F.col("base_failed"), f).alias(f"x{k}") for k, f in enumerate(_features())))
    far = at.join(stored(named, "cell-models"), "pair", "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(cut, P), F.lit(True))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance2", 6).alias("distance2"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL: dict[str, str] = {}
