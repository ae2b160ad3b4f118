"""Secret scans: multipart credentials, linked by an interval join of their parts within scopes.

Method: each text gives parts of credentials. Base parts are strong ones: assignments of secrets, access identifiers and
long hexadecimal runs. Weak candidates are identifiers (names of users and clients, temporary access identifiers, e-mail
addresses), secrets (other assignments, tokens of 40 mixed characters, passwords in a URL) and endpoints (URLs, hosts), none
of which is worth a report alone. Every part stands in a scope: the innermost block in matched braces, or else the section
(what blank lines, `[headers]` and `---` part, outside of blocks). Parts are joined with parts of a complementary role
(secrets with identifiers and with endpoints) that are at most REACH characters away, in bins of that size, where the scope of one
contains that of the other: siblings in a list of blocks are not linked. A weak candidate is reported if it has such a
partner, weak or strong; all base spans stay.

The join's keys are (text, bin): a text with any number of parts is spread over its bins, and a bin holds few, as
parts have a length. Equal rows are joined once. Texts without weak candidates, or without a secret, take no part in it.

Defined cases: a null text is empty. Rows are documents of their own: null or repeated doc_ids make no difference. Texts
of any length are read whole; patterns are linear in the text. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, settled, slices, stored, table

#: Kinds of spans in their order; the first three are base spans.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SECRET, IDENTIFIER, ENDPOINT = range(3)
#: Role of each kind.
ROLES = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT)
#: Characters between two parts of a credential at most.
REACH = 400

_GIVEN = rb"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)" + _GIVEN + rb"([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Weak candidates: the pattern and the group that is the part.
WEAK_SECRETS = (
    (re.compile(rb"(?<![A-Za-z0-9])(?:pwd|pass|passphrase|credentials?|auth|private_?key|access_?key_?secret|signing_?key)" + _GIVEN + rb"([^\s\"',;{}]{6,})", re.I), 1),
    (re.compile(rb"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"), 0),
    (re.compile(rb"://[^\s/:@\"']{1,64}:([^\s/:@\"']{3,128})@"), 1),
)
WEAK_IDENTIFIERS = (
    (re.compile(rb"(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|tenant(?:_?id)?)" + _GIVEN + rb"([A-Za-z0-9@._+-]{3,})", re.I), 1),
    (re.compile(rb"(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{16,}"), 0),
    (re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"), 0),
    (re.compile(rb"://([^\s/:@\"']{1,64}):[^\s/:@\"']{3,128}@"), 1),
)
WEAK_ENDPOINTS = (
    (re.compile(rb"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>{}|\\^`]+"), 0),
    (re.compile(rb"(?<![A-Za-z0-9])(?:host(?:name)?|server|endpoint|url|uri|database_?url)" + _GIVEN + rb"([A-Za-z0-9.-]+\.[A-Za-z0-9-]+(?::[0-9]+)?)", re.I), 1),
)
_EDGES = re.compile(rb"[{}]|\n[ \t\r]*\n|\n---|\n\[[^\]\n]{1,80}\]")

_SPAN = "struct<kind:int,start:long,end:long>"
_PART = "struct<kind:int,start:long,end:long,scope_start:long,scope_end:long>"
_FOUND = f"n_assign long, n_access long, n_hex long, base array<{_SPAN}>, parts array<{_PART}>, digest binary"


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, in order."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(1, *m.span()) for m in ACCESS.finditer(text)] + [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def _mixed(value: bytes) -> bool:
    """Whether a token has letters of both cases and digits, and isn't one character again and again."""
    return bool(re.search(rb"[a-z]", value) and re.search(rb"[A-Z]", value) and re.search(rb"[0-9]", value))


def _candidates(text: bytes, patterns, kind: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts of one kind, without those that overlap a base span of their role or one another; the first pattern goes first."""
    own = sorted((s, e) for k, s, e in taken if ROLES[k] == ROLES[kind])
    found: set[tuple[int, int]] = set()
    for pattern, group in patterns:
        for m in pattern.finditer(text):
            s, e = m.span(group)
            if len(set(text[s : min(e, s + 256)])) >= (4 if kind == 4 else 1) and (group or kind != 4 or _mixed(text[s:e])):
                found.add((s, e))
    out, end, i = [], -1, 0
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(own) and own[i][1] <= s:
            i += 1
        if s >= end and not (i < len(own) and own[i][0] < e):
            out.append((kind, s, e))
            end = e
    return out


def weak_parts(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates, if there may be one with a partner."""
    secrets = _candidates(text, WEAK_SECRETS, 4, base)
    if not secrets and not any(ROLES[k] == SECRET for k, *_ in base):
        return []
    return secrets + _candidates(text, WEAK_IDENTIFIERS, 3, base) + _candidates(text, WEAK_ENDPOINTS, 5, base)


def scopes(text: bytes, parts: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of each part, in order of starts: the innermost pair of braces around its start, or else its section."""
    edges = [(m.start(), m.group()[:1]) for m in _EDGES.finditer(text)]
    open_, pair = [], {}
    for at, what in edges:
        if what == b"{":
            open_.append(at)
        elif what == b"}" and open_:
            pair[start := open_.pop()] = at
            pair[at] = start
    # sections: breaks outside of all pairs
    breaks, depth = [0], 0
    for at, what in edges:
        if what == b"\n":
            if not depth:
                breaks.append(at)
        elif at in pair:
            depth += 1 if what == b"{" else -1
    breaks.append(len(text))
    out, stack, i, k = [], [], 0, 0
    braces = [at for at, what in edges if what != b"\n" and at in pair]
    for _, s, _ in parts:
        while i < len(braces) and braces[i] < s:
            at = braces[i]
            if pair[at] > at:
                stack.append((at, pair[at]))
            else:
                stack.pop()
            i += 1
        while breaks[k + 1] <= s and k + 2 < len(breaks):
            k += 1
        out.append(stack[-1] if stack else (breaks[k], breaks[k + 1]))
    return out


def points(text: bytes, at: list[int]) -> dict[int, int]:
    """The place in code points of each place in bytes."""
    if text.isascii():
        return {x: x for x in at}
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    out, now, before = {}, 0, 0
    for x in sorted(set(at)):
        before += int(np.count_nonzero(first[now:x]))
        out[x], now = before, x
    return out


def _of_text(text: bytes) -> tuple[list, list]:
    """Base spans, and all parts with their scopes if there are weak ones, in code points."""
    base = base_spans(text)
    weak = weak_parts(text, base)
    if not weak and not base:
        return [], []
    parts = sorted(base + weak, key=lambda x: (x[1], x[0])) if weak else []
    around = scopes(text, parts) if parts else []
    p = points(text, [x for _, *se in (*base, *parts) for x in se] + [x for se in around for x in se])
    return [(k, p[s], p[e]) for k, s, e in base], [(k, p[s], p[e], p[a], p[z]) for (k, s, e), (a, z) in zip(parts, around, strict=True)]


def with_parts(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id and the columns of _FOUND. No shuffle; only the text crosses to Python."""

    @released
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        part = pa.struct([*span, ("scope_start", pa.int64()), ("scope_end", pa.int64())])
        for column in batches:
            rows = []
            for _, texts in slices(column):
                for text in texts:
                    base, parts = _of_text(text)
                    digest = hashlib.blake2b(text, digest_size=16).digest() if parts else None
                    rows.append((base, parts, digest))
            n = [pa.array([sum(k == kind for k, *_ in base) for base, _, _ in rows], pa.int64()) for kind in range(3)]
            named = lambda given, kind: pa.array([[dict(zip(kind.names, x, strict=True)) for x in g] for g in given], pa.list_(kind))
            yield pa.StructArray.from_arrays([*n, named((r[0] for r in rows), span), named((r[1] for r in rows), part), pa.array([r[2] for r in rows], pa.binary())], ["n_assign", "n_access", "n_hex", "base", "parts", "digest"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.select("doc_id", F.arrow_udf(run, _FOUND)("text").alias("_f")).select("doc_id", "_f.*")


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """parts: key, kind, start, end, scope_start, scope_end. Pairs of complementary parts in reach whose scopes contain one
    another: key, kind, start, end, gap, and the partner's kind, start, end as other_*.

    An interval join: one side is in the bin of its start, the other in all bins that it reaches."""
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("kind") + 1)
    given = parts.select("key", "kind", "start", "end", "scope_start", "scope_end", role.alias("role"))
    left = given.withColumn("bin", F.floor(F.col("start") / reach))
    right = given.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))))
    right = right.select("key", "bin", *(F.col(c).alias(f"other_{c}") for c in ("kind", "start", "end", "scope_start", "scope_end", "role")))
    gap = F.greatest(F.col("other_start") - F.col("end"), F.col("start") - F.col("other_end"), F.lit(0))
    holds = lambda a, b: (F.col(f"{a}scope_start") <= F.col(f"{b}scope_start")) & (F.col(f"{b}scope_end") <= F.col(f"{a}scope_end"))
    # one of two parts is a secret, the other is none
    complementary = (F.col("role") == SECRET) != (F.col("other_role") == SECRET)
    near = left.join(right, ["key", "bin"]).where(complementary & (gap <= reach) & (holds("", "other_") | holds("other_", "")))
    near = near.select("key", "kind", "start", "end", gap.alias("gap"), "other_kind", "other_start", "other_end")
    # a long part may be within reach of one whose start it doesn't reach: each pair counts for both sides
    back = near.select("key", F.col("other_kind").alias("kind"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), "gap", F.col("kind").alias("other_kind"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return near.unionByName(back)


def credential_links(found: DataFrame, reach: int = REACH) -> DataFrame:
    """found: key and parts. A row for each weak candidate with a partner, and its nearest one: key, kind, start, end, gap, other_kind, other_start, other_end."""
    parts = found.select("key", F.explode("parts").alias("x")).select("key", "x.*").distinct()
    near = F.min(F.struct("gap", "other_start", "other_kind", "other_end")).alias("m")
    return linked_parts(parts, reach).where("kind >= 3").groupBy("key", "kind", "start", "end").agg(near).select("key", "kind", "start", "end", "m.gap", "m.other_kind", "m.other_start", "m.other_end")


def _written(spans: Column) -> Column:
    """kind:start:end of spans, by start and kind, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs: doc_id, text. A row for each: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    key = F.when(F.col("digest").isNotNull(), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex("digest")))
    found = stored(with_parts(docs).withColumn("key", key).drop("digest"), "parts")
    links = credential_links(found.where("key IS NOT NULL").select("key", "parts"), reach)
    links = stored(links.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")), "links")
    asked = found.where("key IS NOT NULL").join(links, "key", "left").withColumn("all", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
    rest = found.where("key IS NULL").withColumn("all", F.col("base"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "all"]
    out = rest.select(names).unionByName(asked.select(names))
    return out.select(*names[:4], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


@settled
def op11_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_credential_links": op11_credential_links}
SQL: dict[str, str] = {}
