"""Toxicity: a weighted finite-state pattern grammar over clauses.

Method: a lexical transducer maps the words of a sentence to insult, threat, target, object, negation, reported-speech and
clause symbols with weights; the composed transducers of the grammar (see grammar.py) read them, once from the right and
once from the left, and give each weight its factor. An insult has its full weight where it is bound to a target in its
clause or is an address; a loose one stays by LOOSE under the cut, so that it takes several to reject a text. A threat weighs by
the object it is against. A text is judged by its strongest stretch of sentences: the sum of their weights less RATE for
each word, as so much is to be expected. A longer text has more stretches that chance could favour, so the
logarithm of its length in texts of USUAL words is taken off. The score is the logistic function of the prior log odds plus
what is left, if anything. Insult stems and their weights are learned from at most SAMPLE labelled texts (those with the
least hashes): word beginnings that toxic texts have and clean ones lack, more surely than CHANCE would have it for
any of the candidates, picked by greedy multiple cover so that copies of one toxic text do not vouch for its other
words. Candidates are counted and judged in the cluster; the driver sees those that pass, and in which texts of the sample
they are. The weight of a threat against the reader starts from THREAT_WEIGHT and follows the same sample.

Defined cases: null, empty or wordless texts have no sentence and get the prior's score. Texts are read whole at any
length. Repeated rows and ties get equal scores; of equally good stems the longer one that sorts last is picked. Null labels are not learned
from; of several labels of a document the greatest counts; without any toxic label only the fixed threat patterns remain. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, stored, table
from .grammar import SENTENCE, THREATS, TOKEN, factors, lexical

#: Labelled texts that the lexicon is learned from, at most.
SAMPLE = 20_000
#: Lengths of word beginnings tried as stems; whole words count as well.
STEMS = (4, 5, 6, 7)
#: Toxic texts that a stem must be seen in, and covers asked of each toxic text.
SUPPORT, COVERS = 4, 4
#: Clean texts for each toxic one in which a stem may be seen and still be certain; how much likelier in toxic texts any
#: stem must be (as a logarithm); and the most that an uncertain one weighs: alone it doesn't reach the cut, two do.
CERTAIN, LIKELIER, UNCERTAIN = 0.02, 2.5, 2.4
#: How likely it may be that any candidate at all would be in as many toxic texts if it were as common in clean ones.
CHANCE = 0.05
#: What a loose insult lacks to the cut at least, as log odds: alone it doesn't reach it, two do.
LOOSE = 0.3
#: Weight a word that is to be expected in toxic texts; and words of a usual text, which the prior is for.
RATE, USUAL = 0.01, 350
#: What a threat against the reader weighs before any label is seen, and the texts that this counts as.
THREAT_WEIGHT, ASSUMED = 4.0, 20
CUT = 0.7

_WORD = re.compile(r"[^\W\d_]+")


class Lexicon(NamedTuple):
    """What is learned: insult stems ($ ends a whole word) with weights, the prior log odds, the weight of a threat."""

    stems: dict[str, float]
    prior: float
    threat: float = THREAT_WEIGHT


class Scorer:
    """The lexical transducer (learned stems, fixed lists) with the composed grammar."""

    def __init__(self, stems: dict[str, float], prior: float, threat: float = THREAT_WEIGHT) -> None:
        import ahocorasick

        self.stems, self.prior, self.threat = stems, prior, threat
        self.loose = max(math.log(CUT / (1 - CUT)) - prior - LOOSE, 0.0)
        self.longest = sorted({len(s.rstrip("$")) for s in stems}, reverse=True)
        self.machine = ahocorasick.Automaton()
        for s in {x.rstrip("$") for x in stems} | THREATS:
            self.machine.add_word(s, len(s))
        self.machine.make_automaton()

    def symbol(self, token: str) -> tuple[str, float]:
        if (w := self.stems.get(token + "$")) is not None:
            return "insult", w
        for n in self.longest:
            if n <= len(token) and (w := self.stems.get(token[:n])) is not None:
                return "insult", w
        s = lexical(token)
        return s, self.threat if s in ("threat", "struck", "clitic") else 0.0

    def sentence(self, tokens: list[str]) -> float:
        found = [self.symbol(t) for t in tokens]
        if not any(w for _, w in found):
            return 0.0
        return sum((min(w, self.loose) if loose else w) * f for (_, w), (f, loose) in zip(found, factors([s for s, _ in found]), strict=True))

    def score(self, text: str | None) -> tuple[float, int]:
        """The score, and the number of sentences with weight."""
        low, hits, n, run, best = (text or "").lower(), 0, 0, 0.0, 0.0
        if any(end < n or not low[end - n].isalpha() for end, n in self.machine.iter(low)):  # else no word begins with a term
            for part in SENTENCE.split(low):
                tokens = TOKEN.findall(part)
                words = sum(t[0].isalpha() for t in tokens)
                weight = self.sentence(tokens)
                n, hits = n + words, hits + (weight > 0)
                run = max(run + weight - RATE * words, 0.0)
                best = max(best, run)
        total = self.prior + max(best - math.log(max(n / USUAL, 1.0)), 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), hits


def _features(text: str | None) -> set[str]:
    """The words of a text (marked with $) and their beginnings."""
    found = set(_WORD.findall((text or "").lower()))
    out = {w + "$" for w in found if len(w) >= 3}
    for n in STEMS:
        out |= {w[:n] for w in found if len(w) >= n}
    return out


def _counted(df: DataFrame, name: str) -> DataFrame:
    """In how many texts each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(_features(t))
                if len(seen) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["feature", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["feature", "n"])

    return df.select("text").mapInArrow(released(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias(name))


def _by_chance(n: int, of: int, share: float) -> float:
    """How likely n or more of so many texts are toxic if each is with the probability share."""
    if n <= of * share:
        return 1.0
    log = lambda k: math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(share) + (of - k) * math.log1p(-share)
    return math.fsum(math.exp(log(k)) for k in range(n, of + 1))


def _covering(rows: list[list[str]], covers: int, support: int) -> list[str]:
    """Features by greedy multiple cover: each pick is what most rows need that aren't covered often enough yet."""
    need = [covers] * len(rows)
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for f in r:
            by.setdefault(f, []).append(i)
    gain = {f: len(v) for f, v in by.items()}
    picked: list[str] = []
    while gain:
        f = max(gain, key=lambda x: (gain[x], -len(x), x))
        real = sum(need[i] > 0 for i in by[f])
        if real < gain[f]:  # lazily brought up to date
            if real < support:
                del gain[f]
            else:
                gain[f] = real
            continue
        if real < support:
            break
        del gain[f]
        if any(p in (f, f[: len(p)]) for p in picked if not p.endswith("$")):
            continue
        picked.append(f)
        for i in by[f]:
            need[i] -= 1
    return picked


def _threatening(rows: DataFrame) -> dict[bool, int]:
    """How many texts of rows (text, _toxic) threaten someone, by toxic or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, n = Scorer({}, 0.0, 1.0), Counter()
        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[toxic] += scorer.score(t)[1] > 0
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.bool_()), pa.array(n.values(), pa.int64())], ["toxic", "n"])

    return {r.toxic: r.n for r in rows.select("text", F.col("_toxic") > 0).mapInArrow(released(run), "toxic boolean, n long").groupBy("toxic").agg(F.sum("n").alias("n")).collect()}


def _threat_weight(toxic: int, n_toxic: int, clean: int, n_clean: int) -> float:
    """How much likelier toxic a text with a threat is than any text, as a logarithm of odds. Starts from ASSUMED texts for which it is THREAT_WEIGHT."""
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    innocent = ASSUMED / (1 + math.exp(THREAT_WEIGHT + prior))
    return max(0.0, math.log((toxic + ASSUMED - innocent) / (clean + innocent)) - prior)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """labels has doc_id and toxic; the sample is the least hashes of doc_id."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # at most `sample` rows of two numbers: small by its parameter
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("_toxic").alias("_toxic"))
    rows = stored(rows, "toxic-sample")
    bad, good = rows.where("_toxic > 0"), rows.where("NOT _toxic > 0")
    n_bad, n_good = bad.count(), good.count()
    prior = math.log((n_bad + 0.5) / (n_good + 0.5)) if n_bad else -3.0
    prior = max(-3.0, min(-1.0, prior))
    if not n_bad:
        return Lexicon({}, prior)
    threats = _threatening(rows)
    threat = _threat_weight(threats.get(True, 0), n_bad, threats.get(False, 0), n_good)
    often = _counted(bad, "toxic").where(F.col("toxic") >= SUPPORT)
    found = stored(often.join(_counted(good, "clean"), "feature", "left").select("feature", "toxic", F.coalesce("clean", F.lit(0)).alias("clean")), "features")
    tried, share = found.count(), (n_bad + 0.5) / (n_bad + n_good + 1)
    weigh = lambda n, m: math.log((n + 0.5) / (n_bad + 1) / ((m + 3) / (n_good + 1)))
    certain = lambda n, m: m <= CERTAIN * n

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = zip(b.column("toxic").to_pylist(), b.column("clean").to_pylist(), strict=True)
            yield b.filter(pa.array([(certain(n, m) or weigh(n, m) >= LIKELIER) and _by_chance(n, n + m, share) * tried < CHANCE for n, m in counts], pa.bool_()))

    counts = {r.feature: (r.toxic, r.clean) for r in found.mapInArrow(judged, found.schema).collect()}
    name = sorted(counts)
    pure = {f: k for k, f in enumerate(name)}

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(pure[f] for f in _features(t) if f in pure) for t in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["features"])

    # at most SAMPLE rows
    lists = [[name[k] for k in r.features] for r in bad.select("text").mapInArrow(kept, "features array<int>").collect()]
    stems = _covering(sorted(lists), COVERS, SUPPORT)
    return Lexicon({f: w if certain(*counts[f]) else min(w, UNCERTAIN) for f in stems if (w := weigh(*counts[f])) > 0.5}, prior, threat)


def scores(text: Column, stems: dict[str, float], prior: float, threat: float = THREAT_WEIGHT) -> Column:
    """A struct of score and sentences with weight. No shuffle; only the text crosses to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(stems, prior, threat)
        kind = pa.struct([("score", pa.float64()), ("clauses", pa.int64())])
        for column in batches:
            got = [scorer.score(t.decode("utf-8", "replace")) for _, part in slices(column) for t in part]
            yield pa.array([{"score": s, "clauses": n} for s, n in got], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "score double, clauses long")(text)


def score_texts(docs: DataFrame, stems: dict[str, float], prior: float, threat: float = THREAT_WEIGHT) -> DataFrame:
    """docs' columns and toxic_score, toxic_clauses (set anew where docs has them)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("toxic_score", "toxic_clauses")]
    return docs.select(*rest, scores(F.col("text"), stems, prior, threat).alias("_t")).select(*rest, F.col("_t.score").alias("toxic_score"), F.col("_t.clauses").alias("toxic_clauses"))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, *learn(docs, table(spark, sf_dir, "labels").where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= CUT).cast("int").alias("predicted"), F.col("toxic_clauses").alias("n_clauses"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score under CUT, with all their columns, whatever the names. The lexicon is learned from
    the rows that aren't held out. Defined cases: as above; a null or empty text stays."""
    learned = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()))
    return docs.where(scores(F.col("text"), *learned)["score"] < CUT)


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
