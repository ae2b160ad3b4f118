"""Scalar text functions as column expressions: JVM-side but for `fixed`, which is for reports."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters that are unified before comparison, Latin to Cyrillic.
LOOKALIKES = (("B", "В"), ("p", "р"), ("ə", "ә"))
#: All white space of Unicode, and the separators U+001C to U+001F.
BLANK = r"(?U)[\s\x1c-\x1f]"
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Fixed value: a part of speech in brackets.
POS_TAG = r"\([а-яА-Яa-zA-Z]+\.?\)"
# Colours of labels, of numbers in turn, and the variables that hold the keys of providers (first hit wins).
LABEL_COLOURS = {"text": "green", "paragraph_title": "blue", "doc_title": "red", "image": "orange", "table": "purple", "number": "gray"}
COLOUR_CYCLE = ("red", "green", "blue", "orange", "purple", "brown")
PROVIDERS = (("openrouter", "OPENROUTER_API_KEY"), ("gemini", "GEMINI_API_KEY"), ("google", "GEMINI_API_KEY"), ("claude", "ANTHROPIC_API_KEY"), ("anthropic", "ANTHROPIC_API_KEY"), ("gpt", "OPENAI_API_KEY"), ("openai", "OPENAI_API_KEY"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_c(x), F.lit(BLANKS))


def normalize_text(x: Column | str, pairs=LOOKALIKES) -> Column:
    """Null to '', look-alikes unified, stripped, lower case, commas to semicolons: in this order."""
    c = F.coalesce(_c(x), F.lit(""))
    if {a for a, _ in pairs} & {b for _, b in pairs}:  # all at once, or one replacement would meet the next
        c = F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    else:  # searching bytes is quicker than looking up each letter
        c = reduce(lambda t, ab: F.replace(t, F.lit(ab[0]), F.lit(ab[1])), pairs, c)
    return F.replace(F.lower(strip(c)), F.lit(","), F.lit(";"))


def tokens(x: Column | str) -> Column:
    """The runs of what isn't white space."""
    return F.filter(F.split(_c(x), f"{BLANK}+"), lambda t: t != "")


def default_if_empty(x: Column | str, other: str = "") -> Column:
    """Null and '' become other."""
    c = _c(x)
    return F.when(c.isNull() | (c == ""), F.lit(other)).otherwise(c)


def strip_code_fence(x: Column | str) -> Column:
    """Trimmed, without a Markdown fence (with or without "json") around it."""
    c = strip(x)
    c = F.regexp_replace(c, r"^```(?:json)?", "")
    return strip(F.regexp_replace(c, r"```$", ""))


def parse_records(x: Column | str, schema: str) -> Column:
    """JSON text to an array of records: an array, an object with "entries", or one object. Null if it is no JSON.

    The text is parsed once. Elements that are no objects are left out; a field's value is its text, that of a nested
    one its JSON. Only what the built-in parser of variants can't take (a name twice in an object) is parsed by a schema."""
    names = [f.split()[0] for f in schema.split(", ")]
    fields = lambda v: F.struct(*(F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in names))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")

    def records(v: Column) -> Column:
        listed = F.coalesce(F.try_variant_get(v, "$.entries", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.when(is_object(v), F.array(v)))
        return F.transform(F.filter(listed, lambda e: e.isNotNull() & is_object(e)), fields)

    text = strip_code_fence(x)
    # as the element of an array the variant has a name, and is made once
    found = F.element_at(F.transform(F.array(F.try_parse_json(text)), lambda v: records(v)), 1)
    return F.coalesce(found, _parsed_by_schema(text, schema))


def _parsed_by_schema(c: Column, schema: str) -> Column:
    listed, one = f"array<struct<{schema.replace(' string', ': string')}>>", f"struct<{schema.replace(' string', ': string')}>"
    wrapped = F.from_json(c, f"struct<entries: {listed}>")["entries"]
    return F.when(c.startswith("["), F.from_json(c, listed)).otherwise(F.coalesce(wrapped, F.when(c.startswith("{"), F.array(F.from_json(c, one)))))


def has_pos_tag(x: Column | str) -> Column:
    return _c(x).rlike(POS_TAG)


def is_bold_headword(height: Column | str, median: Column | str, confidence: Column | str) -> Column:
    return (_c(height) > _c(median) * 1.1) & (_c(confidence) > 0.7)


def is_entry_start(x: Column | str) -> Column:
    """A part-of-speech tag starts an entry; a cross reference or a numbered sense doesn't."""
    c = strip(x)
    return F.when(has_pos_tag(c), True).when(c.startswith("см.") | c.rlike(r"^\d+\."), False).otherwise(False)


def entry_id(column: Column | str, number: Column | str) -> Column:
    return F.format_string("%s%03d", _c(column), _c(number))


def block_id(number: Column | str) -> Column:
    return F.format_string("block_%03d", _c(number))


def ratio_or_zero(x: Column | str, n: Column | str) -> Column:
    """x / n, and 0 where n is not positive."""
    return F.when(_c(n) > 0, _c(x).cast("double") / _c(n)).otherwise(F.lit(0.0))


def fixed(x: Column | str, digits: int) -> Column:
    """A number with so many digits, rounded from its exact binary value (the built-in rounds the shortest decimal up)."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(_c(x).cast("double"))


def percent(x: Column | str, digits: int = 2) -> Column:
    return F.concat(fixed(_c(x) * 100, digits), F.lit("%"))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def with_suffix(path: Column | str, suffix: str) -> Column:
    return F.concat(F.regexp_replace(_c(path), r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def label_colour(label: Column | str, other: str = "black") -> Column:
    return reduce(lambda w, kv: w.when(_c(label) == kv[0], kv[1]), LABEL_COLOURS.items(), F.when(F.lit(False), F.lit(other))).otherwise(other)


def cycle_colour(number: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, COLOUR_CYCLE)), (_c(number) % len(COLOUR_CYCLE) + 1).cast("int"))


def block_caption(label: Column | str, order: Column | str) -> Column:
    return F.concat(_c(label), F.when(_c(order).isNotNull(), F.concat(F.lit(" ["), _c(order).cast("string"), F.lit("]"))).otherwise(""))


def key_variable(model: Column | str) -> Column:
    """The environment variable that holds the key of a model's provider; null if there is none."""
    m = F.lower(_c(model))
    return reduce(lambda w, kv: w.when(m.contains(kv[0]), kv[1]), PROVIDERS, F.when(F.lit(False), F.lit(None)))


def base64_text(content: Column | str) -> Column:
    """Without the line breaks that the built-in puts in."""
    return F.regexp_replace(F.base64(_c(content)), "\r\n", "")
