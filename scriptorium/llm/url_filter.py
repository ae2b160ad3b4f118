"""URL filter: allow and block rules by host and path, then a weighted vocabulary found by Aho-Corasick.

Method: one automaton holds all forms of strict, soft and weak terms (see url_vocabulary.py; any other vocabulary is a
parameter or a table, of at most FORMS forms, as every task holds it; more are an error). A hit counts if no ASCII letter or
digit touches it on either side and no equals sign follows it: the names of a query's values say nothing. The weights of the distinct
terms that are hit are added up, and LIMIT rejects: one strict term, or several distinct softer ones. A rule that fits
decides before the vocabulary.

Defined cases: a null url, or one without ``://``, has empty host and path; its text still meets the vocabulary
(null: no hits, allow). Several forms of a term are one term. Repeated rows each get a verdict. An empty table gives an
empty result. Extra columns are ignored. A url of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .url_vocabulary import LIMIT, vocabulary

#: Forms of a vocabulary that is read from a table, at most: it is held by every task.
FORMS = 200_000
#: (host, path, verdict) of the production query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_LOWER = {i: i + 32 for i in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "host string, path string, rule string, verdict string, n_strict long, n_soft long, weight long"
VOCABULARY = vocabulary()


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


class UrlJudge:
    """Rules by host suffix, and the automaton."""

    def __init__(self, terms: Mapping[str, tuple[str, int]], rules: Sequence[tuple[str, str, str]], limit: int = LIMIT) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for form, (term, weight) in terms.items():
            self.machine.add_word(form, (len(form), term, weight))
        self.machine.make_automaton()
        self.limit = limit
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.rules.setdefault(host, []).append((path, verdict))

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        fits, at = [], 0
        while host and at >= 0:
            suffix = host[at:]
            fits += [(len(suffix) + len(p), suffix + p, v) for p, v in self.rules.get(suffix, ()) if path.startswith(p)]
            at = host.find(".", at) + 1 or -1
        return max(fits)[1:] if fits else None

    def hits(self, url: str) -> tuple[int, dict[str, int]]:
        """Strict hits, and the distinct terms with their weights."""
        text, strict, found = url.translate(_LOWER), 0, {}
        for end, (size, term, weight) in self.machine.iter(text):
            start = end - size + 1
            if (start and text[start - 1] in _WORD) or (end + 1 < len(text) and (text[end + 1] in _WORD or text[end + 1] == "=")):
                continue
            strict += weight >= self.limit
            found[term] = weight
        return strict, found

    def judge(self, url: str | None) -> tuple:
        host, path = parts(url)
        strict, found = self.hits(url or "") if len(self.machine) else (0, {})
        by, weight = self.rule(host, path), sum(found.values())
        verdict = by[1] if by else "block" if weight >= self.limit else "allow"
        return host, path, by and by[0], verdict, strict, sum(w < self.limit for w in found.values()), weight


def read_vocabulary(terms: DataFrame) -> dict[str, tuple[str, int]]:
    """A vocabulary from a table: form, term (null: the form), weight. Forms are lower-cased; the greatest weight counts."""
    rows = terms.where("form <> '' AND weight IS NOT NULL").select(F.lower("form").alias("form"), F.coalesce("term", F.lower("form")).alias("term"), F.col("weight").cast("int").alias("weight"))
    rows = rows.groupBy("form").agg(F.max(F.struct("weight", "term")).alias("x")).limit(FORMS + 1).collect()
    if len(rows) > FORMS:
        raise ValueError(f"more than {FORMS} forms")
    return {r.form: (r.x.term, r.x.weight) for r in rows}


def judge_urls(pages: DataFrame, url: str = "url", terms: Mapping[str, tuple[str, int]] = VOCABULARY, rules: Sequence[tuple[str, str, str]] = RULES, limit: int = LIMIT) -> DataFrame:
    """pages' columns (but for those of SCHEMA, which it sets anew) and the verdict on each url.

    Only the url itself crosses to Python. No shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = UrlJudge(terms, rules, limit)
        kinds = pa.struct([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in SCHEMA.split(", "))])
        for urls in batches:
            rows = [dict(zip(kinds.names, judge.judge(u), strict=True)) for u in urls.to_pylist()]
            yield pa.array(rows, kinds)

    # evaluated by type hints of iterators of arrays
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, SCHEMA)(F.col(url))
    names = [n.split()[0] for n in SCHEMA.split(", ")]
    rest = [c for c in pages.columns if c not in names]
    return pages.select(*(pages[f"`{c}`"] for c in rest), found.alias("_url")).select(*(F.col(f"`{c}`") for c in rest), *(F.col(f"_url.{n}").alias(n) for n in names))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _sql() -> str:
    """As forms are of ASCII letters and digits alone, one with nothing of that kind beside it is a whole run of them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    ruled = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    values = ", ".join(f"('{f}', '{t}', {w})" for f, (t, w) in VOCABULARY.items())
    return f"""
WITH v(form, term, weight) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS k, page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT k, unnest(regexp_split_to_array(regexp_replace(low, '[a-z0-9]+=', '=', 'g'), '[^a-z0-9]+')) AS form FROM u),
f AS (SELECT k, term, weight, count(*) AS n FROM t JOIN v USING (form) GROUP BY k, term, weight),
h AS (SELECT s.*, CAST(coalesce(n_strict, 0) AS BIGINT) AS n_strict, CAST(coalesce(n_soft, 0) AS BIGINT) AS n_soft, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM s LEFT JOIN
    (SELECT k, sum(CASE WHEN weight >= {LIMIT} THEN n ELSE 0 END) AS n_strict, count(*) FILTER (WHERE weight < {LIMIT}) AS n_soft, sum(weight) AS weight FROM f GROUP BY k) USING (k))
SELECT page_id, host, path,
    CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ruled)} END AS rule,
    CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ruled)}
    WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, weight FROM h"""


SQL = {"op6_url_filter": _sql()}
QUERIES = {"op6_url_filter": op6_url_filter}
