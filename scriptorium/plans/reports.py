"""Evaluation of extracted against gold records, end to end: frames first, then texts and JSON.

Reports are written piece by piece: lists that grow with the errors go through the driver a partition at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edits import WORD_OPS
from ..functions.similarity import ratio
from ..operators import matching, metrics
from ..operators.storage import stored
from ..schemas import COMPARED, TSV_FIELDS
from ..sources.writers import json_array, write_text

# Titles and labels of the report texts.
TITLE = "DICTIONARY EXTRACTION EVALUATION REPORT"
ERROR_TITLE = "DETAILED CHARACTER-LEVEL ERROR ANALYSIS"
SUMMARY = (
    ("Total entries in ground truth", "total_gold"),
    ("Total entries extracted", "total_extracted"),
    ("Exact matches", "exact_matches"),
    ("Partial matches", "partial_matches"),
    ("Missing entries", "missing_entries"),
    ("Extra entries", "extra_entries"),
)
PERFORMANCE = (("Overall F1 Score", "overall_f1"), ("Precision", "precision"), ("Recall", "recall"))
ACCURACY = (("Headword accuracy", "headword_accuracy"), ("Grammatical info accuracy", "grammatical_accuracy"), ("Definition accuracy", "definition_accuracy"))
SECTIONS = (
    ("substitution", "Substitutions", "Original → Wrong", "% of Subs"),
    ("deletion", "Deletions", "Deleted Character", "% of Dels"),
    ("insertion", "Insertions", "Inserted Character", "% of Ins"),
)
JSON_METRICS = ("total_gold", "total_extracted", "exact_matches", "partial_matches", "missing_entries", "extra_entries", "headword_accuracy", "grammatical_accuracy", "definition_accuracy", "overall_f1", "precision", "recall")


@dataclass
class Evaluation:
    """Frames, all with the key columns."""

    counts: DataFrame
    matches: DataFrame
    missing: DataFrame
    extra: DataFrame
    records: DataFrame
    totals: DataFrame
    edits: DataFrame
    rates: DataFrame
    confusions: DataFrame
    examples: DataFrame
    fields: DataFrame
    words: DataFrame


def evaluate(gold: DataFrame, extracted: DataFrame, keys: Sequence[str] = (), partial: float = matching.PARTIAL, similarity=ratio) -> Evaluation:
    """Everything that the reports show, for one page or for many runs at once."""
    matches = stored(matching.match_records(gold, extracted, keys, partial, similarity), "matches")
    records = matching.with_records(matches, gold, extracted, keys)
    pairs = stored(metrics.field_pairs(records, keys), "fields")
    edits = stored(metrics.edit_rows(pairs, keys), "edits")
    totals, confusions = metrics.error_totals(pairs, keys), metrics.confusions(edits, keys)
    return Evaluation(
        metrics.match_counts(gold, extracted, matches, keys), matches, matching.missing(gold, matches, keys), matching.extra(extracted, matches, keys), records, totals, edits,
        metrics.op_rates(edits, totals, keys), confusions, metrics.example_rows(edits, confusions, keys), metrics.field_stats(pairs, edits, keys), metrics.word_errors(pairs, keys),
    )


def _head(title: str, rule: str, width: int) -> list[str]:
    return [title, rule * width]


def _listing(title: str, entries: DataFrame) -> list[str]:
    total = entries.count()
    if not total:
        return []
    rows = entries.orderBy("seq").limit(10).collect()
    more = [f"... and {total - 10} more"] if total > 10 else []
    return [*_head(f"{title} (First 10):", "-", 40), *(f"{k}. {r.Headword_Phrase} ({r.POS})" for k, r in enumerate(rows, 1)), *more, ""]


def evaluation_text(e: Evaluation) -> str:
    m = e.counts.first()
    out = ["=" * 60, TITLE, "=" * 60, ""]
    out += [*_head("SUMMARY STATISTICS:", "-", 40), *(f"{label}: {m[c]}" for label, c in SUMMARY), ""]
    for title, rows in (("PERFORMANCE METRICS:", PERFORMANCE), ("FIELD-LEVEL ACCURACY:", ACCURACY)):
        out += [*_head(title, "-", 40), *(f"{label}: {m[c]:.3f}" for label, c in rows), ""]
    out += _listing("MISSING ENTRIES", e.missing) + _listing("EXTRA ENTRIES", e.extra)
    low = matching.low_scores(e.records, 5).collect()
    if low:
        out += _head("LOW-SCORING MATCHES (First 5):", "-", 40)
        for k, r in enumerate(low, 1):
            out += [f"{k}. Ground Truth: {r.gold.Headword_Phrase}", f"   Extracted: {r.extracted.Headword_Phrase}", f"   Score: {r.overall:.3f}", ""]
    return "\n".join(out)


def _plain(rows: Iterable, fields: Sequence[str] = TSV_FIELDS) -> Iterator[dict]:
    return ({f: r[f] for f in fields} for r in rows)


def _object(items: Iterable[tuple[str, Iterable[str]]]) -> Iterator[str]:
    """A pretty object, value by value."""
    first = True
    for k, parts in items:
        yield ("{\n  " if first else ",\n  ") + json.dumps(k, ensure_ascii=False) + ": "
        yield from parts
        first = False
    yield "\n}"


def _value(x, depth: int = 1) -> Iterator[str]:
    yield json.dumps(x, ensure_ascii=False, indent=2).replace("\n", "\n" + "  " * depth)


def evaluation_json(e: Evaluation) -> Iterator[str]:
    m = e.counts.first()
    names = {"total_gold": "total_ground_truth"}
    low = matching.low_scores(e.records, 10).collect()
    scores = [
        {"ground_truth": next(_plain([r.gold])), "extracted": next(_plain([r.extracted])), "scores": {"overall": r.overall, "headword": r.head_score, "grammatical": r.pos_score, "definition": r.def_score}}
        for r in low
    ]
    return _object([
        ("metrics", _value({names.get(c, c): m[c] for c in JSON_METRICS})), ("missing_entries", json_array(_plain(e.missing.orderBy("seq").toLocalIterator()), 1)),
        ("extra_entries", json_array(_plain(e.extra.orderBy("seq").toLocalIterator()), 1)), ("low_score_matches", _value(scores)),
    ])


def _sections(e: Evaluation, op: str) -> Iterator[tuple]:
    """The top confusions of an op, each with its examples, which are to be used up before the next."""
    rows = e.examples.where(F.col("op") == op).orderBy("rank", "pair_seq", "field_no", "op_no").toLocalIterator()
    for _, group in groupby(rows, key=lambda r: r["rank"]):
        first = next(group)
        yield first, ((r.gold_raw, r.ext_raw) for r in (r for part in ((first,), group) for r in part))


def error_text(e: Evaluation) -> Iterator[str]:
    t, r = e.totals.first(), e.rates.first()
    rate = lambda v: f"{v * 100:.2f}%"
    out = ["=" * 80, ERROR_TITLE, "=" * 80, ""]
    out += [f"{label}: {v:.4f} ({rate(v)})" for label, v in (("Character Error Rate (CER)", t.cer), ("Word Error Rate (WER)", t.wer))] + [""]
    out += [f"Total characters analyzed: {t.total_chars:,}", f"Total character errors: {t.char_errors:,}", ""]
    summary = {op: f"{label}: {r[op + 's']:,} ({rate(r[op + '_rate'])} of all characters)" for op, label, *_ in SECTIONS}
    out += [*_head("CHARACTER-LEVEL ERROR BREAKDOWN:", "-", 80), *("  " + x for x in summary.values()), ""]
    yield "\n".join(out)
    for op, label, first, share in SECTIONS:
        name, _, rest = summary[op].partition(":")
        yield "\n" + "\n".join(["=" * 80, f"{name.upper()}:{rest}", "=" * 80])
        if not r[op + "s"]:
            yield f"\nNo {label.lower()} found.\n"
            continue
        yield "\n" + "\n".join([f"{first:<35} {'Count':<10} {share:<12} {'% of Total'}", "-" * 80])
        for x, examples in _sections(e, op):
            shown = " → ".join(repr(c) for c in ((x.gt, x.ext) if op == "substitution" else (x.gt or x.ext,)))
            yield f"\n{shown:<35} {x.n:<10} {x.share * 100:>6.2f}%       {x.n / t.total_chars * 100:>6.2f}%"
            yield from (f"\n    Example: {a} → {b}" for a, b in examples)
        yield "\n"
    out = ["", "=" * 80, "ERROR RATES BY FIELD:", "=" * 80, f"{'Field':<25} {'Chars':<10} {'Subs':<8} {'Dels':<8} {'Ins':<8} {'CER'}", "-" * 80]
    rows = {x.field: x for x in e.fields.collect()}  # one row for each compared field
    out += [f"{f:<25} {x.chars:<10} {x.substitutions:<8} {x.deletions:<8} {x.insertions:<8} {x.cer:.4f}" for f in COMPARED if (x := rows.get(f)) and x.chars]
    yield "\n".join([*out, ""])


def error_json(e: Evaluation) -> Iterator[str]:
    t, r, w = e.totals.first(), e.rates.first(), e.words.first()

    def found(op: str) -> Iterator[str]:
        """The array of an op's confusions; their examples one by one."""
        first = True
        for x, examples in _sections(e, op):
            who = {"from": x.gt, "to": x.ext} if op == "substitution" else {"character": x.gt or x.ext}
            head = json.dumps(who | {"count": x.n}, ensure_ascii=False, indent=2).replace("\n", "\n" + " " * 6)
            yield ("[\n" if first else ",\n") + " " * 6 + head[: head.rindex("\n")] + ",\n" + " " * 8 + '"examples": '
            yield from json_array(({"ground_truth": a, "extracted": b} for a, b in examples), 4)
            yield "\n" + " " * 6 + "}"
            first = False
        yield "[]" if first else "\n    ]"

    def section(op: str) -> Iterator[str]:
        yield "{\n" + "".join(f"    {json.dumps(k)}: {json.dumps(v)},\n" for k, v in (("count", r[op + "s"]), ("rate", r[op + "_rate"]))) + '    "most_common": '
        yield from found(op)
        yield "\n  }"

    rows = {x.field: x for x in e.fields.collect()}  # one row for each compared field
    fields = {f: {"chars": x.chars, "subs": x.substitutions, "dels": x.deletions, "ins": x.insertions} for f in COMPARED if (x := rows.get(f))}
    head = {"cer": t.cer, "wer": t.wer, "total_chars": t.total_chars, "total_words": t.total_words, "total_char_errors": t.char_errors, "total_word_errors": t.word_errors}
    words = {o: w[f"word_{o}"] for o in WORD_OPS}
    return _object([*((k, _value(v)) for k, v in head.items()), *((f"{op}s", section(op)) for op, *_ in SECTIONS), ("word_errors", _value(words)), ("field_stats", _value(fields))])


def write_reports(e: Evaluation, folder: str, characters: bool = True) -> list[str]:
    """The texts, each with its JSON beside it. Without any match there is no character report."""
    spark, made = e.counts.sparkSession, []
    kinds = [("evaluation_report", lambda e: [evaluation_text(e)], evaluation_json)]
    if characters and not e.matches.isEmpty():
        kinds.append(("character_error_report", error_text, error_json))
    for name, as_text, as_json in kinds:
        for path, parts in ((f"{folder}/{name}.txt", as_text(e)), (f"{folder}/{name}_details.json", as_json(e))):
            write_text(spark, path, parts)
            made.append(path)
    return made
