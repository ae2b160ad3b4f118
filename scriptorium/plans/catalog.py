"""Queries over the test tables, each with its SQL where SQL can express it.

The tables hold no dictionary pages, so operators run on analogues: parts against a noisy copy of themselves as gold
and extracted records, events as positioned lines (time is the vertical place, users are pages)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.similarity import edit_ratio, ratio
from ..operators import experiments, layout, matching, metrics, scan, segment
from ..operators.storage import shared_dir, stored
from ..schemas import FIELDS, JSON_RECORD, LAYOUT
from ..sources import incremental, parts, readers, table_functions, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_MAP = "translate(coalesce({0}, ''), 'Bpə', 'Врә')"
_NORM = "translate(lower(regexp_replace(" + _MAP + r", '^\s+|\s+$', '', 'g')), ',', ';')"


# --- scalar functions -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length({_NORM.format('text')}) AS n, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize_text("text").alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(r"SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS BIGINT) AS n_tokens, CAST(length(text) AS BIGINT) AS n_chars FROM conversations")
def tokenize_counts(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(text.tokens("text")).cast("long").alias("n_tokens"), F.length("text").cast("long").alias("n_chars"))


@query("""SELECT d.doc_id, CASE WHEN coalesce(d.source, '') = '' THEN 'word' ELSE d.source END AS entry_type,
CASE WHEN l.quality IS NULL THEN 'none' ELSE CAST(l.quality AS VARCHAR) END AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND d.text <> ''""")
def default_and_filter_entries(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").where(F.col("text") != "")
    return rows.select("doc_id", text.default_if_empty("source", "word").alias("entry_type"), text.default_if_empty(F.col("quality").cast("string"), "none").alias("quality"))


@query("SELECT lang, count(*) FILTER (WHERE n_chars >= 500) AS kept, count(*) FILTER (WHERE NOT n_chars >= 500) AS dropped FROM documents GROUP BY lang")
def kept_and_dropped(spark, d):
    return metrics.kept_and_dropped(_t(spark, d, "documents"), F.col("n_chars") >= 500, ["lang"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def strip_fence_parse_json(spark, d):
    fenced = F.concat(F.lit(" ```json\n"), "props", F.lit("\n```\n"))
    return _t(spark, d, "events").select("event_id", F.get_json_object(text.strip_code_fence(fenced), "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, CAST(0 AS BIGINT) AS seq, p_name AS headword_phrase, CASE WHEN p_size % 2 = 0 THEN 'word' ELSE p_type END AS entry_type FROM part WHERE p_name <> ''")
def parse_records_dispatch(spark, d):
    """Answers of three shapes: an array, an object with entries, one object."""
    kind = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))
    one = F.struct(F.col("p_name").alias("headword_phrase"), kind.alias("entry_type"))
    shape = F.col("p_partkey") % 3
    answer = F.when(shape == 0, F.to_json(F.array(one))).when(shape == 1, F.to_json(F.struct(F.array(one).alias("entries")))).otherwise(F.to_json(one))
    rows = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("answer"))
    return readers.records_of_answers(rows).select("p_partkey", F.col("seq").cast("long").alias("seq"), "headword_phrase", "entry_type")


_TAGGED = "CASE WHEN p_size % 3 = 0 THEN p_name || ' (' || p_type || '.)' WHEN p_size % 3 = 1 THEN p_name || ' (' || p_type || ' 1)' ELSE '12. ' || p_name END"


@query(f"SELECT p_partkey, regexp_matches({_TAGGED}, '\\([а-яА-Яa-zA-Z]+\\.?\\)') AS tagged, p_size % 3 = 0 AS starts FROM part")
def pos_tag_match(spark, d):
    t = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(".)"))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" ("), "p_type", F.lit(" 1)"))).otherwise(F.concat(F.lit("12. "), "p_name"))
    return _t(spark, d, "part").select("p_partkey", text.has_pos_tag(t).alias("tagged"), text.is_entry_start(t).alias("starts"))


@query("SELECT event_id, value > median(value) OVER (PARTITION BY user_id) * 1.1 AND (event_id % 10) / 10.0 > 0.7 AS bold FROM events")
def bold_headword(spark, d):
    """Against the median of the page (user)."""
    rows = _t(spark, d, "events")
    mid = rows.groupBy("user_id").agg(F.median("value").alias("mid"))
    return rows.join(mid, "user_id").select("event_id", text.is_bold_headword("value", "mid", F.col("event_id") % 10 / 10.0).alias("bold"))


@query("SELECT p_partkey, translate(lower(translate(p_name, 'aeo', 'äëö')), ',', ';') AS other, translate(lower(p_name), ',', ';') AS none FROM part")
def normalize_other_pairs(spark, d):
    """Normalisation with other look-alikes, and with none."""
    pairs = (("a", "ä"), ("e", "ë"), ("o", "ö"))
    return _t(spark, d, "part").select("p_partkey", text.normalize_text("p_name", pairs).alias("other"), text.normalize_text("p_name", ()).alias("none"))


@query("SELECT label, count(*) AS n, CASE label % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'purple' ELSE 'black' END AS colour, CASE label % 6 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' WHEN 3 THEN 'orange' WHEN 4 THEN 'purple' ELSE 'brown' END AS cycle, CASE label % 3 WHEN 0 THEN 'text [' || label || ']' WHEN 1 THEN 'table' ELSE 'other [' || label || ']' END AS caption FROM embeddings GROUP BY label")
def label_colours(spark, d):
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("other")), (F.col("label") % 3 + 1).cast("int"))
    order = F.when(F.col("label") % 3 != 1, F.col("label"))
    rows = _t(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("label", "n", text.label_colour(kind).alias("colour"), text.cycle_colour("label").alias("cycle"), text.block_caption(kind, order).alias("caption"))


_MODEL = "CASE p_partkey % 5 WHEN 0 THEN 'openrouter/GPT-x' WHEN 1 THEN 'Gemini-pro' WHEN 2 THEN 'anthropic/c' WHEN 3 THEN 'gpt-x' ELSE p_name END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'OPENROUTER_API_KEY' WHEN 1 THEN 'GEMINI_API_KEY' WHEN 2 THEN 'ANTHROPIC_API_KEY' WHEN 3 THEN 'OPENAI_API_KEY' END AS variable FROM part")
def model_key_lookup(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.key_variable(F.expr(_MODEL)).alias("variable"))


@query("SELECT page_id, base64(CAST(url AS BLOB)) AS encoded FROM pages")
def base64_encode(spark, d):
    return _t(spark, d, "pages").select("page_id", text.base64_text(F.col("url").cast("binary")).alias("encoded"))


@query("SELECT p_partkey, 'L' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS entry_id, 'block_' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS block_id FROM part")
def format_ids(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.entry_id(F.lit("L"), "p_size").alias("entry_id"), text.block_id("p_size").alias("block_id"))


@query("SELECT page_id, regexp_extract(u, '([^/]*)/*$', 1) AS name, regexp_replace(regexp_extract(u, '([^/]*)/*$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS u FROM pages)")
def path_functions(spark, d):
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return _t(spark, d, "pages").select("page_id", text.name(path).alias("name"), text.stem(path).alias("stem"))


@query("SELECT c_mktsegment, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN CAST(count(*) AS DOUBLE) / count(*) FILTER (WHERE c_acctbal < 0) ELSE 0.0 END AS ratio FROM customer GROUP BY c_mktsegment")
def guarded_ratio(spark, d):
    rows = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("m"))
    return rows.select("c_mktsegment", text.ratio_or_zero("n", "m").alias("ratio"))


# --- geometry ---------------------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(list_min(list_transform(range(0, 4), lambda i: embedding[2 * i + 1])) AS DOUBLE) AS x_min, CAST(list_min(list_transform(range(0, 4), lambda i: embedding[2 * i + 2])) AS DOUBLE) AS y_min, CAST(list_max(list_transform(range(0, 4), lambda i: embedding[2 * i + 1])) AS DOUBLE) AS x_max, CAST(list_max(list_transform(range(0, 4), lambda i: embedding[2 * i + 2])) AS DOUBLE) AS y_max FROM embeddings")
def polygon_bbox(spark, d):
    poly = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(*(F.element_at("embedding", i * 2 + k).cast("double") for k in (1, 2))))
    return _t(spark, d, "embeddings").select("vec_id", geometry.polygon_box(poly).alias("b")).select("vec_id", "b.*")


@query("""SELECT l_orderkey, l_linenumber, greatest(0, CAST(trunc(l_quantity - 20) AS INTEGER)) AS x_min, least(60, CAST(trunc(l_quantity + 10 + 20) AS INTEGER)) AS x_max,
l_quantity + 5.0 AS cx, CAST(10 AS DOUBLE) AS width FROM lineitem""")
def crop_clamp(spark, d):
    q = F.col("l_quantity")
    box = F.struct(q.alias("x_min"), q.alias("y_min"), (q + 10).alias("x_max"), (q + 10).alias("y_max"))
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("bbox"))
    measures = geometry.box_measures("bbox")
    return rows.select("l_orderkey", "l_linenumber", geometry.crop_box("bbox", F.lit(60), F.lit(60)).alias("c"), measures[0], measures[2]).select("l_orderkey", "l_linenumber", "c.x_min", "c.x_max", "cx", "width")


@query("SELECT l_orderkey, count(*) AS n_blocks, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'N') AS n_text_blocks FROM lineitem GROUP BY l_orderkey")
def block_filter_counts(spark, d):
    box = F.when(F.col("l_returnflag") != "N", F.array(*(F.lit(0.0) for _ in range(4)))).otherwise(F.array(F.lit(0.0)))
    block = F.struct(F.when(F.col("l_linestatus") == "F", "text").otherwise("table").alias("block_label"), box.alias("block_bbox"))
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(block).alias("parsing_res_list"))
    return layout.block_counts(rows.withColumnRenamed("l_orderkey", "input_path")).withColumnRenamed("input_path", "l_orderkey")


def _layouts(spark, d) -> DataFrame:
    """Orders as pages: a block for each line, some without content, with another label, or with a box that is none."""
    box = F.when(F.col("l_returnflag") != "N", F.array("l_quantity", "l_quantity", F.col("l_quantity") + 10.5, F.col("l_quantity") + 20)).otherwise(F.array("l_quantity", "l_quantity"))
    block = F.struct(
        F.col("l_linenumber").alias("block_order"), F.when(F.col("l_linestatus") == "F", "text").otherwise("table").alias("block_label"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("line "), "l_linenumber")).otherwise("").alias("block_content"), F.transform(box, lambda v: v.cast("double")).alias("block_bbox"), F.col("l_linenumber").cast("int").alias("block_id"),
    )
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(block)).alias("parsing_res_list"))
    return rows.select(F.concat(F.lit("pages/"), "l_orderkey", F.lit(".png")).alias("input_path"), F.lit(100).alias("width"), F.lit(100).alias("height"), "parsing_res_list")


_BLOCKS = "(SELECT 'pages/' || l_orderkey || '.png' AS input_path, l_linenumber AS n, CASE WHEN l_linestatus = 'F' THEN 'text' ELSE 'table' END AS label, CASE WHEN l_linenumber % 3 <> 0 THEN 'line ' || l_linenumber ELSE '' END AS content, l_quantity AS q FROM lineitem WHERE l_returnflag <> 'N')"


@query(f"SELECT input_path, 'block_' || lpad(CAST(n AS VARCHAR), 3, '0') || '_text' AS name, content AS block_content, CAST(trunc(q) AS INTEGER) AS x0, CAST(trunc(q + 10.5) AS INTEGER) AS x1 FROM {_BLOCKS} WHERE label = 'text' AND content <> ''")
def text_blocks(spark, d):
    """Blocks that are extracted: labelled text, with content, and with a box of four numbers."""
    found = layout.block_files(layout.layout_blocks(_layouts(spark, d)))
    return found.select("input_path", "name", "block_content", F.col("box")[0].alias("x0"), F.col("box")[2].alias("x1"))


@query(f"SELECT input_path, CAST(trunc(q + 20) AS INTEGER) AS y1, CASE label WHEN 'text' THEN 'green' ELSE 'purple' END AS colour, label || ' [' || n || ']' AS caption FROM {_BLOCKS}")
def drawn_blocks(spark, d):
    """Blocks that are drawn: all with a box of four numbers."""
    found = layout.annotations(layout.layout_blocks(_layouts(spark, d), text_only=False))
    return found.select("input_path", F.col("box")[3].alias("y1"), "colour", "caption")


# --- character and word errors ----------------------------------------------------------------------------------

#: Parts and a copy with swapped vowels, a lost sign and an added one.
_PAIRS = """(SELECT p_partkey AS pair_seq, 0 AS field_no, 'name' AS field, p_name AS gt, translate(p_name, 'aeo', '{0}') AS ext FROM part
UNION ALL SELECT p_partkey, 1, 'brand', p_brand, replace(p_brand, '#', '') FROM part
UNION ALL SELECT p_partkey, 2, 'type', p_type, p_type || '!' FROM part)"""


def _pairs(spark, d, swap: str) -> DataFrame:
    cells = [("name", F.col("p_name"), F.translate("p_name", "aeo", swap)), ("brand", F.col("p_brand"), F.regexp_replace("p_brand", "#", "")), ("type", F.col("p_type"), F.concat("p_type", F.lit("!")))]
    struct = [F.struct(F.lit(i).alias("field_no"), F.lit(n).alias("field"), a.alias("gt"), b.alias("ext")) for i, (n, a, b) in enumerate(cells)]
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("pair_seq"), F.explode(F.array(*struct)).alias("x")).select("pair_seq", "x.*")
    return rows.withColumn("gold_raw", F.col("gt")).withColumn("ext_raw", F.col("ext"))


_WORDS = "array_to_string(list_transform({0}, lambda w: chr(CAST(64 + list_position(list_distinct(list_concat(a, b)), w) AS INTEGER))), '')"
_ERRORS = f"""SELECT {{0}} CAST(sum(length(gt)) AS BIGINT) AS total_chars, CAST(sum(levenshtein(gt, ext)) AS BIGINT) AS char_errors, CAST(sum(len(a)) AS BIGINT) AS total_words,
CAST(sum(levenshtein({_WORDS.format('a')}, {_WORDS.format('b')})) AS BIGINT) AS word_errors,
CAST(sum(levenshtein(gt, ext)) AS DOUBLE) / CAST(sum(length(gt)) AS DOUBLE) AS cer, CAST(sum(levenshtein({_WORDS.format('a')}, {_WORDS.format('b')})) AS DOUBLE) / CAST(sum(len(a)) AS DOUBLE) AS wer
FROM (SELECT *, string_split(gt, ' ') AS a, string_split(ext, ' ') AS b FROM {_PAIRS.format('eoa')})"""


@query(_ERRORS.format(""))
def cer_totals(spark, d):
    return metrics.error_totals(_pairs(spark, d, "eoa"))


@query(_ERRORS.format("field,") + " GROUP BY field")
def cer_by_field(spark, d):
    return metrics.error_totals(_pairs(spark, d, "eoa"), ["field"])


@query(_ERRORS.format("field,") + " GROUP BY ROLLUP (field)")
def cer_rollup(spark, d):
    return metrics.error_totals(_pairs(spark, d, "eoa"), ["field"], rollup=True)


#: Normalised turns in letters of one byte each, as the engine of the SQL counts bytes.
_ONE_BYTE = "translate(" + _NORM + ", 'врәóéñèíüçêäöß', '@pQ' || chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16))"


@query(f"""SELECT role, CAST(sum(length(gt)) AS BIGINT) AS total_chars, CAST(sum(levenshtein(gt, ext)) AS BIGINT) AS char_errors, CAST(sum(w) AS BIGINT) AS total_words, CAST(sum(levenshtein(gt, ext)) AS DOUBLE) / CAST(sum(length(gt)) AS DOUBLE) AS cer FROM
(SELECT role, len(list_filter(regexp_split_to_array({_NORM.format('text')}, '\\s+'), lambda t: t <> '')) AS w, {_ONE_BYTE.format('text')} AS gt, {_ONE_BYTE.format("replace(translate(text, 'ae', 'ea'), ',', '')")} AS ext FROM conversations) GROUP BY role""")
def cer_conversations(spark, d):
    """Whole turns against a copy with swapped vowels and lost commas, by role."""
    rows = _t(spark, d, "conversations").repartition("conv_id", "turn").select("role", text.normalize_text("text").alias("gt"), text.normalize_text(F.regexp_replace(F.translate("text", "ae", "ea"), ",", "")).alias("ext"))
    return metrics.error_totals(rows, ["role"]).select("role", "total_chars", "char_errors", "total_words", "cer")


_WORD_ERRORS = f"""SELECT field, CAST(sum(len(a)) AS BIGINT) AS total_words, CAST(sum(n) AS BIGINT) AS word_substitutions, CAST(0 AS BIGINT) AS word_deletions, CAST(0 AS BIGINT) AS word_insertions, CAST(sum(n) AS DOUBLE) / CAST(sum(len(a)) AS DOUBLE) AS wer FROM
(SELECT field, a, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS n FROM (SELECT field, string_split(gt, ' ') AS a, string_split(ext, ' ') AS b FROM {_PAIRS.format('479')})) GROUP BY field"""


@query(_WORD_ERRORS)
def word_errors(spark, d):
    """Words that are replaced, dropped and added: the copies keep the number of words."""
    return metrics.word_errors(_pairs(spark, d, "479"), ["field"])


@query(_WORD_ERRORS)
def word_errors_blocks(spark, d):
    """The same by matching blocks, as where no edit distance is at hand."""
    return metrics.word_errors(_pairs(spark, d, "479"), ["field"], mode="blocks")


_LATIN, _OTHER = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0x3B1 + i) for i in range(26)) + "".join(chr(0x410 + i) for i in range(26))


@query(f"""SELECT 'substitution' AS op, gt, ext, n, share, CAST(rank AS INTEGER) AS rank FROM (SELECT gt, ext, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share, row_number() OVER (ORDER BY n DESC, first) AS rank FROM
(SELECT gt, ext, count(*) AS n, min((pair_seq, i)) AS first FROM (SELECT pair_seq, i, substr(t, i, 1) AS gt, translate(substr(t, i, 1), '{_LATIN}', '{_OTHER}') AS ext FROM
(SELECT pair_seq, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT conv_id * 1000 + turn AS pair_seq, text AS t FROM conversations))) WHERE gt <> ext GROUP BY gt, ext)) WHERE rank <= 30""")
def confusions_of_turns(spark, d):
    """The 30 most frequent of some fifty confusions: whole turns against a copy with other letters."""
    rows = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_seq"), F.lit(0).alias("field_no"), F.lit("turn").alias("field"), F.col("text").alias("gt"), F.translate("text", _LATIN, _OTHER).alias("ext"))
    rows = rows.withColumn("gold_raw", F.lit("")).withColumn("ext_raw", F.lit(""))
    return metrics.confusions(metrics.edit_rows(rows.where("gt IS NOT NULL")))


_EDITS = f"""(SELECT pair_seq, field_no, 'substitution' AS op, substr(gt, i, 1) AS gt, substr(ext, i, 1) AS ext, i AS pos, gt AS gold_raw, ext AS ext_raw, field FROM
    (SELECT *, unnest(range(1, length(gt) + 1)) AS i FROM {_PAIRS.format('479')} WHERE field = 'name') WHERE substr(gt, i, 1) <> substr(ext, i, 1)
UNION ALL SELECT pair_seq, field_no, 'deletion', '#', '', 1, gt, ext, field FROM {_PAIRS.format('479')} WHERE field = 'brand'
UNION ALL SELECT pair_seq, field_no, 'insertion', '', '!', 1, gt, ext, field FROM {_PAIRS.format('479')} WHERE field = 'type')"""


def _edits(spark, d) -> DataFrame:
    return metrics.edit_rows(_pairs(spark, d, "479"))


@query(f"""SELECT total_chars, substitutions, deletions, insertions, CAST(substitutions AS DOUBLE) / total_chars AS substitution_rate, CAST(deletions AS DOUBLE) / total_chars AS deletion_rate, CAST(insertions AS DOUBLE) / total_chars AS insertion_rate FROM
(SELECT count(*) FILTER (WHERE op = 'substitution') AS substitutions, count(*) FILTER (WHERE op = 'deletion') AS deletions, count(*) FILTER (WHERE op = 'insertion') AS insertions FROM {_EDITS}),
(SELECT CAST(sum(length(gt)) AS BIGINT) AS total_chars FROM {_PAIRS.format('479')})""")
def op_rates(spark, d):
    return metrics.op_rates(_edits(spark, d), metrics.error_totals(_pairs(spark, d, "479")))


_RANKED = f"""SELECT op, gt, ext, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY op) AS DOUBLE) AS share, row_number() OVER (PARTITION BY op ORDER BY n DESC, first) AS rank FROM
(SELECT op, gt, ext, count(*) AS n, min((pair_seq, field_no, pos)) AS first FROM {_EDITS} GROUP BY op, gt, ext)"""


@query(f"SELECT op, gt, ext, n, CAST(rank AS INTEGER) AS rank FROM ({_RANKED}) WHERE rank <= 30")
def confusion_top30(spark, d):
    return metrics.confusions(_edits(spark, d)).drop("share")


@query(f"SELECT op, gt, ext, n, share, CAST(rank AS INTEGER) AS rank FROM ({_RANKED})")
def confusion_share(spark, d):
    return metrics.confusions(_edits(spark, d), top=None)


@query(f"SELECT op, gt, ext, e.pair_seq, e.field_no, e.gold_raw, e.ext_raw, r.n, CAST(r.rank AS INTEGER) AS rank FROM {_EDITS} e JOIN ({_RANKED}) r USING (op, gt, ext) WHERE r.rank <= 30")
def confusion_examples(spark, d):
    """A row for each example of the confusions that are shown."""
    edits = _edits(spark, d)
    return metrics.example_rows(edits, metrics.confusions(edits)).select("op", "gt", "ext", "pair_seq", "field_no", "gold_raw", "ext_raw", "n", "rank")


@query(f"SELECT op, gt, ext, len(x) AS n, md5(array_to_string(x, ';')) AS digest FROM (SELECT op, gt, ext, list(gold_raw || '>' || ext_raw ORDER BY pair_seq, field_no, pos)[:20] AS x FROM {_EDITS} GROUP BY op, gt, ext)")
def first_examples(spark, d):
    """The first 20 examples of each confusion, in order."""
    listed = metrics.confusion_examples(_edits(spark, d), most=20)
    return listed.select("op", "gt", "ext", F.size("examples").cast("long").alias("n"), F.md5(F.array_join(F.transform("examples", lambda s: F.concat(s["gold"], F.lit(">"), s["extracted"])), ";")).alias("digest"))


@query(f"""SELECT field, CAST(chars AS BIGINT) AS chars, coalesce(s, 0) AS substitutions, coalesce(de, 0) AS deletions, coalesce(i, 0) AS insertions, CAST(coalesce(s, 0) + coalesce(de, 0) + coalesce(i, 0) AS DOUBLE) / CAST(chars AS DOUBLE) AS cer FROM
(SELECT field, sum(length(gt)) AS chars FROM {_PAIRS.format('479')} GROUP BY field) LEFT JOIN
(SELECT field, count(*) FILTER (WHERE op = 'substitution') AS s, count(*) FILTER (WHERE op = 'deletion') AS de, count(*) FILTER (WHERE op = 'insertion') AS i FROM {_EDITS} GROUP BY field) USING (field)""")
def field_stats(spark, d):
    return metrics.field_stats(_pairs(spark, d, "479"), _edits(spark, d))


#: difflib's matching blocks of texts (a, b): the longest common run of a part of both (the earliest in a, then in b), then what is left and right of it.
_RUN = "len(list_filter(range(1, least(ah - i, bh - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n)))"
_LONGEST = f"coalesce(list_max(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j: {_RUN} * 1000000 + (999 - i) * 1000 + (999 - j))))), 0)"
_PARTS = f"""parts AS (SELECT a, b, al, ah, bl, bh, {_LONGEST} AS x FROM (SELECT a, b, 0::BIGINT AS al, length(a) AS ah, 0::BIGINT AS bl, length(b) AS bh FROM texts)
    UNION ALL SELECT a, b, al, ah, bl, bh, {_LONGEST} AS x FROM (SELECT a, b, al, 999 - x // 1000 % 1000 AS ah, bl, 999 - x % 1000 AS bh FROM parts WHERE x >= 1000000
        UNION ALL SELECT a, b, 999 - x // 1000 % 1000 + x // 1000000, ah, 999 - x % 1000 + x // 1000000, bh FROM parts WHERE x >= 1000000) WHERE al < ah AND bl < bh)"""
_BLOCK_OPS = f"""WITH RECURSIVE texts AS (SELECT field, gt AS a, ext AS b, count(*) AS n FROM {_PAIRS.format('eoa')} GROUP BY ALL), {_PARTS},
blocks AS (SELECT DISTINCT a, b, 999 - x // 1000 % 1000 AS i, 999 - x % 1000 AS j, x // 1000000 AS k FROM parts WHERE x >= 1000000 UNION ALL SELECT DISTINCT a, b, length(a), length(b), 0 FROM texts),
gaps AS (SELECT a, b, i - coalesce(lag(i + k) OVER w, 0) AS di, j - coalesce(lag(j + k) OVER w, 0) AS dj FROM blocks WINDOW w AS (PARTITION BY a, b ORDER BY i, j)),
ops AS (SELECT a, b, sum(least(di, dj)) AS substitution, sum(greatest(di - dj, 0)) AS deletion, sum(greatest(dj - di, 0)) AS insertion FROM gaps GROUP BY a, b)
SELECT field, op, CAST(sum(n * m) AS BIGINT) AS n FROM texts JOIN (UNPIVOT ops ON substitution, deletion, insertion INTO NAME op VALUE m) USING (a, b) GROUP BY field, op HAVING sum(n * m) > 0"""


#: The same for long texts: a run is a piece of a diagonal, cut to the part; popular letters of a long b begin none but prolong it (f, to).
_LEADING = "len(list_filter(range(1, least(ah - al, bh - bl) + 1), lambda n: substr(a, al + 1, n) = substr(b, bl + 1, n)))"
_CUT = "list_max(list_transform(runs, lambda r: {'n': least(r.s + r.n, ah, bh + r.d) - greatest(r.s, al, bl + r.d), 'i': -greatest(r.s, al, bl + r.d), 'j': r.d - greatest(r.s, al, bl + r.d), 'f': r.f, 'e': r.e}))"
_BOX = f"""SELECT k, al, ah, bl, bh, CASE WHEN x.n > 0 THEN greatest(x.f, al, bl + x.j - x.i) ELSE al END AS lo, CASE WHEN x.n > 0 THEN x.j - x.i ELSE al - bl END AS d,
    CASE WHEN x.n > 0 THEN least(x.e, ah, bh + x.j - x.i) ELSE al + {_LEADING} END AS hi FROM (SELECT *, {_CUT} AS x FROM (GIVEN) JOIN lists USING (k))"""
_LONG_RATIO = f"""WITH RECURSIVE texts AS (SELECT row_number() OVER () AS k, a, substr(c, length(c) // 3 + 1) || substr(c, 1, length(c) // 3) AS b FROM (SELECT a, replace(a, 'th', 'd') AS c FROM (SELECT DISTINCT coalesce(text, '') AS a FROM conversations))),
ca AS (SELECT k, i - 1 AS i, substr(a, i, 1) AS c FROM (SELECT k, a, unnest(range(1, length(a) + 1)) AS i FROM texts)),
cb AS (SELECT k, j - 1 AS j, substr(b, j, 1) AS c, n, count(*) OVER (PARTITION BY k, substr(b, j, 1)) AS m FROM (SELECT k, b, length(b) AS n, unnest(range(1, length(b) + 1)) AS j FROM texts)),
cells AS (SELECT k, i, i - j AS d, n < 200 OR m <= n // 100 + 1 AS core FROM ca JOIN cb USING (k, c)),
whole AS (SELECT k, d, min(i) AS f, max(i) + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY k, d ORDER BY i) AS g FROM cells) GROUP BY k, d, g),
cores AS (SELECT k, d, min(i) AS s, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY k, d ORDER BY i) AS g FROM cells WHERE core) GROUP BY k, d, g),
lists AS (SELECT k, a, b, coalesce(runs, []) AS runs FROM texts LEFT JOIN (SELECT k, list({{'s': s, 'n': n, 'd': d, 'f': f, 'e': e}}) AS runs FROM cores c JOIN whole w USING (k, d) WHERE f <= s AND s < e GROUP BY k) USING (k)),
parts AS ({_BOX.replace("GIVEN", "SELECT k, 0::BIGINT AS al, length(a) AS ah, 0::BIGINT AS bl, length(b) AS bh FROM texts WHERE a <> ''")}
    UNION ALL {_BOX.replace("GIVEN", "SELECT * FROM (SELECT k, al, lo AS ah, bl, lo - d AS bh FROM parts WHERE hi > lo UNION ALL SELECT k, hi, ah, hi - d, bh FROM parts WHERE hi > lo) WHERE al < ah AND bl < bh")}),
ratios AS (SELECT a, CASE WHEN a = '' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * total / (length(a) + length(b)) END AS r FROM texts LEFT JOIN (SELECT k, sum(hi - lo) AS total FROM parts GROUP BY k) USING (k))
SELECT conv_id, turn, round(r, 9) AS ratio FROM conversations JOIN ratios ON a = coalesce(text, '')"""


@query(_LONG_RATIO)
def block_ratio_of_turns(spark, d):
    """Whole turns, most of them of more than 200 letters, against a copy that is turned round and has fewer letters."""
    changed = F.replace(F.coalesce("text", F.lit("")), F.lit("th"), F.lit("d"))
    third = F.floor(F.length("c") / 3).cast("int")
    rows = _t(spark, d, "conversations").withColumn("c", changed).withColumn("b", F.concat(F.substring("c", third + 1, F.length("c")), F.substring("c", F.lit(1), third)))
    return rows.select("conv_id", "turn", F.round(ratio("text", "b"), 9).alias("ratio"))


@query(_BLOCK_OPS)
def block_edit_ops(spark, d):
    """The alternative alignment by matching blocks: counts of its edits."""
    return metrics.edit_rows(_pairs(spark, d, "eoa"), mode="blocks").groupBy("field", "op").agg(F.count(F.lit(1)).alias("n"))


# --- segmentation -----------------------------------------------------------------------------------------------

_LINES = """(SELECT user_id, event_id AS seq, CAST(epoch_us(ts) AS DOUBLE) AS y_min, CAST(epoch_us(ts) AS DOUBLE) + floor(value * 1000000) AS y_max, value AS x_min, value + 1 AS x_max,
CASE WHEN (value + value + 1) / 2 < 50.0 / 2 THEN 'L' ELSE 'R' END AS col FROM events)"""
_W = "PARTITION BY user_id, col ORDER BY y_min, x_min, seq"
_GAPS = f"(SELECT *, y_min - lag(y_max) OVER ({_W}) AS gap FROM {_LINES})"
_MID = f"(SELECT user_id, col, coalesce(median(gap), 0) AS median_gap, min(x_min) AS left_margin, count(*) AS n_lines FROM {_GAPS} GROUP BY user_id, col)"
_STATS = f"(SELECT user_id, col, any_value(median_gap) AS median_gap, coalesce(median(abs(gap - median_gap)), 0) AS mad_gap, any_value(left_margin) AS left_margin, quantile_cont(x_min - left_margin, 0.25) AS indent_q1, any_value(n_lines) AS n_lines FROM {_GAPS} g JOIN {_MID} m USING (user_id, col) GROUP BY user_id, col)"
_NUMBERED = f"(SELECT *, CAST(sum(CASE WHEN gap > median_gap + 2.0 * mad_gap THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS INTEGER) AS entry_no FROM {_GAPS} g JOIN (SELECT user_id, col, median_gap, mad_gap FROM {_STATS}) s USING (user_id, col))"


def _lines(spark, d) -> DataFrame:
    y, v = F.unix_micros(F.col("ts").cast("timestamp")).cast("double"), F.col("value")
    box = F.struct(v.alias("x_min"), y.alias("y_min"), (v + 1).alias("x_max"), (y + F.floor(v * 1000000)).alias("y_max"))
    rows = _t(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), box.alias("bbox"), F.col("event_type").alias("text"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    return segment.split_columns(rows, 50.0)


_KEYS = ["user_id", "column"]


@query(f'SELECT user_id, col AS "column", count(*) AS n_lines FROM {_LINES} GROUP BY user_id, col')
def segment_columns(spark, d):
    return _lines(spark, d).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_lines"))


@query(f'SELECT user_id, col AS "column", seq, CAST(row_number() OVER ({_W}) - 1 AS INTEGER) AS "order", gap FROM {_GAPS}')
def reading_order(spark, d):
    return segment.reading_order(_lines(spark, d), _KEYS).select(*_KEYS, "seq", "order", "gap")


@query(f'SELECT user_id, col AS "column", median_gap, mad_gap, left_margin, round(indent_q1, 6) AS indent_q1, n_lines, median_gap + 2.0 * mad_gap AS "limit" FROM {_STATS}')
def gap_stats(spark, d):
    return segment.gap_stats(_lines(spark, d), _KEYS).withColumn("indent_q1", F.round("indent_q1", 6)).select(*_KEYS, "median_gap", "mad_gap", "left_margin", "indent_q1", "n_lines", "limit")


@query(f"""SELECT user_id, col || lpad(CAST(entry_no AS VARCHAR), CAST(greatest(3, length(CAST(entry_no AS VARCHAR))) AS INTEGER), '0') AS entry_id, count(*) AS n_lines, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max,
string_agg(CAST(seq AS VARCHAR), ',' ORDER BY y_min, x_min, seq) AS seqs FROM {_NUMBERED} GROUP BY user_id, col, entry_no""")
def segment_entries(spark, d):
    lines = _lines(spark, d).withColumn("text", F.col("seq").cast("string"))
    e = segment.segment_entries(lines, ["user_id"])
    return e.select("user_id", "entry_id", "n_lines", "bbox.*", F.array_join(F.transform("lines", lambda x: x["text"]), ",").alias("seqs"))


@query(f"""SELECT user_id, col || lpad(CAST(entry_no AS VARCHAR), CAST(greatest(3, length(CAST(entry_no AS VARCHAR))) AS INTEGER), '0') AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY col, entry_no) - 1 AS place FROM (SELECT DISTINCT user_id, col, entry_no FROM {_NUMBERED})""")
def page_order(spark, d):
    """Entries in the order of their page: the left column, then the right one."""
    return segment.in_page_order(segment.segment_entries(_lines(spark, d), ["user_id"]), ["user_id"]).select("user_id", "entry_id", "place")


# One page of all events: no task sees it whole.

def _keyless(sql: str) -> str:
    """The SQL of the whole table as one page of one column: the same, without keys."""
    for old, new in (("PARTITION BY user_id, col ", ""), (" GROUP BY user_id, col", ""), ("SELECT user_id, col, ", "SELECT "), (" USING (user_id, col)", " ON true")):
        sql = sql.replace(old, new)
    return sql


@query(f'SELECT median_gap, mad_gap, left_margin, round(indent_q1, 6) AS indent_q1, n_lines, median_gap + 2.0 * mad_gap AS "limit" FROM {_keyless(_STATS)}')
def gap_stats_whole(spark, d):
    """Exact medians and a quartile of the whole table."""
    return segment.gap_stats(_lines(spark, d), []).withColumn("indent_q1", F.round("indent_q1", 6)).select("median_gap", "mad_gap", "left_margin", "indent_q1", "n_lines", "limit")


@query(f'SELECT seq, CAST(row_number() OVER ({_keyless(_W)}) - 1 AS INTEGER) AS "order", gap, entry_no FROM {_keyless(_NUMBERED)}')
def entry_numbers_whole(spark, d):
    return segment.entry_numbers(_lines(spark, d), []).select("seq", "order", "gap", "entry_no")


@query(f'SELECT user_id, col AS "column", seq, CAST(row_number() OVER ({_W}) - 1 AS INTEGER) AS "order", gap, entry_no FROM {_NUMBERED}')
def entry_numbers_heavy(spark, d):
    """Keys of more than 5 lines are scanned in parts, the others by windows."""
    return segment.entry_numbers(_lines(spark, d), _KEYS, rows=5).select(*_KEYS, "seq", "order", "gap", "entry_no")


@query("SELECT l_returnflag, median(l_extendedprice) AS mid, quantile_cont(l_quantity, 0.25) AS low, round(quantile_cont(l_extendedprice, 0.9), 4) AS high FROM lineitem GROUP BY l_returnflag")
def quantiles_of_few_keys(spark, d):
    """Three keys that hold everything, by ranks."""
    rows = _t(spark, d, "lineitem").select("l_returnflag", *(F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity")))
    heavy = scan.heavy_keys(rows, ["l_returnflag"], 1_000)
    got = scan.quantiles(rows, ["l_returnflag"], {"mid": ("l_extendedprice", 0.5), "low": ("l_quantity", 0.25), "high": ("l_extendedprice", 0.9)}, heavy)
    return got.withColumn("high", F.round("high", 4))


@query("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 10 / 10.0 >= 0.5 GROUP BY user_id")
def confidence_filter(spark, d):
    rows = _t(spark, d, "events").groupBy("user_id").agg(
        F.collect_list(F.array(F.array(F.col("value"), F.col("value")))).alias("dt_polys"), F.collect_list(F.col("event_id").cast("string")).alias("rec_texts"), F.collect_list(F.col("event_id") % 10 / 10.0).alias("rec_scores")
    )
    return segment.ocr_lines(rows, ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").cast("long")).alias("ids"))


# --- matching ---------------------------------------------------------------------------------------------------

_GROUP = ["p_brand", "p_size"]


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Gold: all parts. Extracted: a noisy copy, every seventh part lost. Parts match within a brand and size."""
    part = _t(spark, d, "part")
    blank = [F.lit("").alias(c) for c in ("Entry_Type", "Literal_Meaning", "Grammar_Notes")]
    gold = part.select(*_GROUP, F.col("p_partkey").alias("seq"), F.col("p_name").alias("Headword_Phrase"), F.col("p_type").alias("POS"), F.concat("p_type", F.lit(" "), "p_name").alias("Translation_RU"), *blank)
    noisy = F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", "aeo", "eoa")).otherwise(F.col("p_name"))
    other = part.where(F.col("p_partkey") % 7 != 0).select(*_GROUP, F.col("p_partkey").alias("seq"), noisy.alias("Headword_Phrase"), F.col("p_type").alias("POS"), F.concat("p_type", F.lit(" "), noisy).alias("Translation_RU"), *blank)
    return gold, other


_EXT = "CASE WHEN p_partkey % 3 = 0 THEN translate(p_name, 'aeo', 'eoa') ELSE p_name END"
_N = "translate(lower(translate({0}, 'Bpə', 'Врә')), ',', ';')"
#: The edit ratio. The Cyrillic letters that normalisation puts in go back to ASCII ones, as the engine counts bytes.
_ASCII = "replace({0}, 'р', 'p')"
_R = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0::DOUBLE ELSE 1 - CAST(levenshtein(" + _ASCII.format("{0}") + ", " + _ASCII.format("{1}") + ") AS DOUBLE) / greatest(length({0}), length({1})) END"
_RECORDS = f"""g AS (SELECT p_brand, p_size, p_partkey AS seq, {_N.format('p_name')} AS h, {_N.format('p_type')} AS p, {_N.format("p_type || ' ' || p_name")} AS t FROM part),
e AS (SELECT p_brand, p_size, p_partkey AS seq, {_N.format(_EXT)} AS h, {_N.format('p_type')} AS p, {_N.format("p_type || ' ' || " + _EXT)} AS t FROM part WHERE p_partkey % 7 <> 0)"""
_EDIT_SCORES = f"s AS (SELECT p_brand, p_size, g.seq AS g_seq, e.seq AS e_seq, {_R.format('g.h', 'e.h')} AS head_score, {_R.format('g.p', 'e.p')} AS pos_score, {_R.format('g.t', 'e.t')} AS def_score FROM g JOIN e USING (p_brand, p_size))"
_BLOCK_SCORES = f"""texts(a, b) AS (SELECT DISTINCT unnest([g.h, g.p, g.t]), unnest([e.h, e.p, e.t]) FROM g JOIN e USING (p_brand, p_size)),
{_PARTS},
ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * sum(x // 1000000) / (length(a) + length(b)) END AS r FROM parts GROUP BY a, b),
s AS (SELECT p_brand, p_size, g.seq AS g_seq, e.seq AS e_seq, h.r AS head_score, p.r AS pos_score, t.r AS def_score FROM g JOIN e USING (p_brand, p_size)
    JOIN ratios h ON h.a = g.h AND h.b = e.h JOIN ratios p ON p.a = g.p AND p.b = e.p JOIN ratios t ON t.a = g.t AND t.b = e.t)"""
_ASSIGNED = """c AS (SELECT *, 0.5::DOUBLE * head_score + 0.15::DOUBLE * pos_score + 0.35::DOUBLE * def_score AS overall FROM s WHERE head_score >= 0.7),
n AS (SELECT p_brand, p_size, seq, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY seq) AS k FROM g),
l AS (SELECT g_seq, list(e_seq ORDER BY overall DESC, e_seq) AS es FROM c GROUP BY g_seq),
m(p_brand, p_size, k, used, g_seq, e_seq) AS (SELECT DISTINCT p_brand, p_size, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM g
    UNION ALL SELECT m.p_brand, m.p_size, n.k, CASE WHEN x.e IS NULL THEN m.used ELSE list_append(m.used, x.e) END, n.seq, x.e FROM m JOIN n ON n.p_brand = m.p_brand AND n.p_size = m.p_size AND n.k = m.k + 1
    LEFT JOIN l ON l.g_seq = n.seq, LATERAL (SELECT list_filter(l.es, lambda y: NOT list_contains(m.used, y))[1] AS e) x),
w AS (SELECT c.*, CASE WHEN head_score = 1.0 AND pos_score >= 0.9 AND def_score >= 0.9 THEN 'exact' WHEN overall >= 0.85 THEN 'partial' ELSE 'below' END AS match_class FROM c JOIN m ON m.g_seq = c.g_seq AND m.e_seq = c.e_seq)"""
_CAND, _CAND_BLOCKS = (f"{_RECORDS}, {x}, {_ASSIGNED}" for x in (_EDIT_SCORES, _BLOCK_SCORES))
_SCORES = "round(head_score, 9) AS head_score, round(pos_score, 9) AS pos_score, round(def_score, 9) AS def_score, round(overall, 9) AS overall"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("head_score", "pos_score", "def_score", "overall")})


def _matches(spark, d):
    gold, other = _sides(spark, d)
    return gold, other, stored(matching.match_records(gold, other, _GROUP, similarity=edit_ratio), "matches")


@query(f"WITH RECURSIVE {_CAND} SELECT p_brand, p_size, g_seq, e_seq, {_SCORES} FROM c")
def candidate_pairs(spark, d):
    return _rounded(matching.candidate_pairs(*_sides(spark, d), _GROUP, similarity=edit_ratio))


_NAMED = "substr(md5(CAST(p_partkey AS VARCHAR)), 1, 16 + p_partkey % 4)"


@query(f"""SELECT g AS g_head, e AS e_head, round(1 - levenshtein(g, e) / CAST(greatest(length(g), length(e)) AS DOUBLE), 9) AS head_score FROM (SELECT DISTINCT {_NAMED} AS g FROM part),
(SELECT DISTINCT substr(x, 1, 4) || substr(x, 6, 5) || 'xy' || substr(x, 12) AS e FROM (SELECT {_NAMED} AS x FROM part WHERE p_partkey % 7 <> 0)) WHERE 1 - levenshtein(g, e) / CAST(greatest(length(g), length(e)) AS DOUBLE) >= 0.7""")
def similar_heads_whole(spark, d):
    """Similar names of a whole table without page keys: candidates by pieces of the names."""
    x = F.expr("substring(md5(cast(p_partkey AS string)), 1, cast(16 + p_partkey % 4 AS int))")
    rows = _t(spark, d, "part").select("p_partkey", x.alias("g_head"))
    changed = F.concat(F.substring("g_head", 1, 4), F.substring("g_head", 6, 5), F.lit("xy"), F.expr("substring(g_head, 12)"))
    return matching.similar_heads(rows, rows.where("p_partkey % 7 <> 0").select(changed.alias("e_head")), similarity=edit_ratio).withColumn("head_score", F.round("head_score", 9))


@query(f"WITH RECURSIVE {_CAND_BLOCKS} SELECT p_brand, p_size, g_seq, e_seq, {_SCORES} FROM c")
def candidate_pairs_blocks(spark, d):
    """Candidates by the matching-block ratio (difflib)."""
    return _rounded(matching.candidate_pairs(*_sides(spark, d), _GROUP, similarity=ratio))


@query(f"WITH RECURSIVE {_CAND} SELECT p_brand, p_size, g_seq, e_seq, {_SCORES}, match_class FROM w")
def greedy_match(spark, d):
    return _rounded(_matches(spark, d)[2])


@query(f"WITH RECURSIVE {_CAND_BLOCKS} SELECT p_brand, p_size, g_seq, e_seq, {_SCORES}, match_class FROM w")
def greedy_match_blocks(spark, d):
    """The assignment by the matching-block ratio (difflib)."""
    gold, other = _sides(spark, d)
    return _rounded(matching.match_records(gold, other, _GROUP, similarity=ratio))


@query(f"WITH RECURSIVE {_CAND} SELECT p_brand, p_size, seq FROM g WHERE seq NOT IN (SELECT g_seq FROM w)")
def missing_entries(spark, d):
    gold, _, m = _matches(spark, d)
    return matching.missing(gold, m, _GROUP).select(*_GROUP, "seq")


@query(f"WITH RECURSIVE {_CAND} SELECT p_brand, p_size, seq FROM e WHERE seq NOT IN (SELECT e_seq FROM w)")
def extra_entries(spark, d):
    _, other, m = _matches(spark, d)
    return matching.extra(other, m, _GROUP).select(*_GROUP, "seq")


@query(f"WITH RECURSIVE {_CAND} SELECT match_class, count(*) AS n FROM w GROUP BY match_class")
def match_classes(spark, d):
    return _matches(spark, d)[2].groupBy("match_class").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = f"""WITH RECURSIVE {_CAND}, t AS (SELECT (SELECT count(*) FROM g) AS total_gold, (SELECT count(*) FROM e) AS total_extracted, count(*) AS paired, count(*) FILTER (WHERE match_class = 'exact') AS exact_matches,
count(*) FILTER (WHERE match_class = 'partial') AS partial_matches, avg(head_score) AS ha, avg(pos_score) AS ga, avg(def_score) AS da FROM w),
r AS (SELECT *, CAST(exact_matches + partial_matches AS DOUBLE) / total_extracted AS p, CAST(exact_matches + partial_matches AS DOUBLE) / total_gold AS r FROM t)"""


@query(f"""{_COUNTS} SELECT total_gold, total_extracted, exact_matches, partial_matches, total_gold - paired AS missing_entries, total_extracted - paired AS extra_entries,
p AS "precision", r AS recall, 2 * p * r / (p + r) AS overall_f1 FROM r""")
def precision_recall_f1(spark, d):
    return metrics.match_counts(*_matches(spark, d)).drop("headword_accuracy", "grammatical_accuracy", "definition_accuracy")


@query(f"{_COUNTS} SELECT round(ha, 9) AS headword_accuracy, round(ga, 9) AS grammatical_accuracy, round(da, 9) AS definition_accuracy FROM r")
def field_accuracy(spark, d):
    names = ("headword_accuracy", "grammatical_accuracy", "definition_accuracy")
    return metrics.match_counts(*_matches(spark, d)).select(*(F.round(n, 9).alias(n) for n in names))


@query(f"WITH RECURSIVE {_CAND} SELECT g_seq, e_seq, round(overall, 9) AS overall FROM w WHERE overall < 0.9 ORDER BY g_seq LIMIT 5")
def low_score_first5(spark, d):
    return matching.low_scores(_matches(spark, d)[2], 5).select("g_seq", "e_seq", F.round("overall", 9).alias("overall"))


@query(f"WITH RECURSIVE {_CAND}, x AS (SELECT seq FROM g WHERE seq NOT IN (SELECT g_seq FROM w)) SELECT seq, greatest((SELECT count(*) FROM x) - 10, 0) AS more FROM x ORDER BY seq LIMIT 10")
def head10_remainder(spark, d):
    gold, _, m = _matches(spark, d)
    left = stored(matching.missing(gold, m, _GROUP).select("seq"), "missing")
    total = left.agg(F.greatest(F.count(F.lit(1)) - 10, F.lit(0)).alias("more")).withColumn("_all", F.lit(0))
    return left.orderBy("seq").limit(10).withColumn("_all", F.lit(0)).join(total, "_all").select("seq", "more")


@query(f"""WITH RECURSIVE {_CAND}, f AS (SELECT w.g_seq, 'Headword_Phrase' AS field, g.h AS gt, e.h AS ext FROM w JOIN g ON g.seq = w.g_seq JOIN e ON e.seq = w.e_seq UNION ALL
SELECT w.g_seq, 'POS', g.p, e.p FROM w JOIN g ON g.seq = w.g_seq JOIN e ON e.seq = w.e_seq UNION ALL SELECT w.g_seq, 'Translation_RU', g.t, e.t FROM w JOIN g ON g.seq = w.g_seq JOIN e ON e.seq = w.e_seq)
SELECT field, CAST(sum(length(gt)) AS BIGINT) AS total_chars, CAST(sum(levenshtein({_ASCII.format('gt')}, {_ASCII.format('ext')})) AS BIGINT) AS char_errors FROM f GROUP BY field""")
def matched_field_errors(spark, d):
    gold, other, m = _matches(spark, d)
    rows = metrics.field_pairs(matching.with_records(m, gold, other, _GROUP), _GROUP)
    return metrics.error_totals(rows, ["field"]).select("field", "total_chars", "char_errors")


_ARTICLES = "SELECT s_suppkey AS seq, s_name AS Headword_Phrase, 'say \"' || s_name || '\"' AS Entry_Type, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'n.' END AS POS, 'two' || chr(10) || 'lines' || chr(9) || s_suppkey AS Translation_RU, '' AS Literal_Meaning, CAST(s_nationkey AS VARCHAR) AS Grammar_Notes FROM supplier"


def _articles(spark, d) -> DataFrame:
    """Records with quotes, tabs, line breaks and empty cells."""
    cells = [F.col("s_name"), F.concat(F.lit('say "'), "s_name", F.lit('"')), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("n."), F.concat(F.lit("two\nlines\t"), "s_suppkey"), F.lit(""), F.col("s_nationkey").cast("string")]
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), *(c.alias(n) for c, n in zip(cells, FIELDS.values(), strict=True)))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query(f"SELECT row_number() OVER (ORDER BY a.seq) - 1 AS place, * EXCLUDE (seq) FROM ({_ARTICLES}) a")
def tsv_file(spark, d):
    """Written as tab-separated parts in order, the last ones appended, and read again with places; a batch that comes twice counts once."""
    path, rows = f"{_folder(spark)}/a", _articles(spark, d)
    parts.write_tsv(rows.where("seq <= 50"), path, ["seq"], drop=["seq"])
    for _ in range(2):
        parts.write_tsv(rows.where("seq > 50"), path, ["seq"], append=True, batch="rest", drop=["seq"])
    return parts.read_tsv(spark, path).select("place", *FIELDS.values())


@query(f"SELECT * EXCLUDE (seq) FROM ({_ARTICLES})")
def tsv_parts(spark, d):
    """Written as many tab-separated files and read again."""
    path = _folder(spark)
    writers.write_tsv_parts(_articles(spark, d), path)
    return readers.read_tsv(spark, path).select(*FIELDS.values())


@query(f"SELECT row_number() OVER (ORDER BY a.seq) - 1 AS place, * EXCLUDE (seq) FROM ({_ARTICLES}) a")
def json_file(spark, d):
    """Written as JSON arrays in order and read again with places."""
    path = f"{_folder(spark)}/a"
    parts.write_json(_articles(spark, d).select("seq", *(F.col(v).alias(k) for k, v in FIELDS.items())), path, ["seq"], drop=["seq"])
    return parts.read_json(spark, path, JSON_RECORD).select("place", *(F.col(k).alias(v) for k, v in FIELDS.items()))


@query(f"SELECT input_path, count(*) AS n, CAST(sum(n) AS BIGINT) AS orders FROM {_BLOCKS} WHERE label = 'text' AND content <> '' GROUP BY input_path")
def layout_files(spark, d):
    """Layouts written as JSON and read again."""
    path = f"{_folder(spark)}/l"
    parts.write_json(_layouts(spark, d), path)
    return layout.layout_blocks(parts.read_json(spark, path, LAYOUT)).groupBy("input_path").agg(F.count(F.lit(1)).alias("n"), F.sum("block_order").alias("orders"))


@query("SELECT n_nationkey || '.png' AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'md ' || n_name ELSE 'txt ' || n_name END AS text FROM nation WHERE n_nationkey % 3 <> 2 OR n_nationkey % 2 = 0 ORDER BY name")
def sidecar_files(spark, d):
    """Images with the texts beside them in a folder, in the order of their names: Markdown first, else plain text."""
    folder, rows = _folder(spark), _t(spark, d, "nation")
    file = lambda ending, kind: F.struct(F.concat(F.col("n_nationkey").cast("string"), F.lit(ending)).alias("name"), F.concat(F.lit(kind), "n_name").cast("binary").alias("content"))
    n = F.col("n_nationkey")
    each = F.array(file(".png", "image "), F.when(n % 3 == 0, file(".md", "md ")), F.when((n % 3 != 2) | (n % 2 == 0), file(".txt", "txt ")))
    parts.write_files(rows.select(F.explode(F.array_compact(each)).alias("f")).select("f.*"), folder)
    texts = readers.read_texts(spark, f"{folder}/*.{{md,txt}}").withColumn("kind", F.regexp_extract("path", r"\.([^.]*)$", 1))
    found = layout.with_sidecar(readers.read_images(spark, folder, "*.png"), texts.where("kind = 'md'"), texts.where("kind = 'txt'"))
    return found.orderBy("name").select("name", "text")


_SHAPES = """CASE p_partkey % 4 WHEN 0 THEN '[{"headword_phrase": "' || p_name || '", "pos": 5, "grammar_notes": {"a": [1, "x"]}}, "text", null, 7, {"headword_phrase": ""}, {"headword_phrase": "second", "entry_type": null}]'
WHEN 1 THEN '{"entries": [{"headword_phrase": "' || p_name || '", "literal_meaning": true}, []]}' WHEN 2 THEN '{"headword_phrase": "' || p_name || '", "entries": 3}' ELSE 'sorry, ' || p_name END"""


@query("""SELECT p_partkey, CAST(0 AS BIGINT) AS seq, p_name AS headword_phrase, 'word' AS entry_type, CASE WHEN p_partkey % 4 = 0 THEN '5' ELSE '' END AS pos, CASE WHEN p_partkey % 4 = 1 THEN 'true' ELSE '' END AS literal_meaning,
CASE WHEN p_partkey % 4 = 0 THEN '{"a":[1,"x"]}' ELSE '' END AS grammar_notes FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, 2, 'second', 'word', '', '', '' FROM part WHERE p_partkey % 4 = 0""")
def mixed_answers(spark, d):
    """Arrays that mix records with texts, nulls and numbers, values of any kind, and answers that are no JSON."""
    rows = readers.records_of_answers(_t(spark, d, "part").select("p_partkey", F.expr(_SHAPES).alias("answer")), strict=False)
    return rows.select("p_partkey", F.col("seq").cast("long").alias("seq"), "headword_phrase", "entry_type", "pos", "literal_meaning", "grammar_notes")


@query("""SELECT p_brand, p_partkey, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY p_brand, error IS NULL ORDER BY p_partkey, seq) - 1 END AS "no", seq, headword_phrase, pos, error FROM
(SELECT p_brand, p_partkey, 0::BIGINT AS seq, p_name AS headword_phrase, CASE WHEN p_partkey % 4 = 0 THEN '5' ELSE '' END AS pos, NULL AS error FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT p_brand, p_partkey, 1, 'second', '', NULL FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_brand, p_partkey, NULL, NULL, NULL, 'JSONDecodeError: Expecting value: line 1 column 1 (char 0)' FROM part WHERE p_partkey % 4 = 3)""")
def extract_in_sql(spark, d):
    """Records of answers by a table function, numbered within a brand in the order of its parts; an item that fails is a row with its error."""
    table_functions.register(spark)
    _t(spark, d, "part").select("p_brand", "p_partkey", F.expr(_SHAPES).alias("text")).createOrReplaceTempView("scriptorium_items")
    return spark.sql("SELECT p_brand, p_partkey, no, seq, headword_phrase, pos, error FROM extract_records(TABLE(scriptorium_items) PARTITION BY p_brand ORDER BY (p_partkey), 'given')")


@query("SELECT conv_id, turn, length(text) + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN conv_id % 5 = 0 OR conv_id % 2 = 1 THEN 2 ELSE 1 END AS delivery FROM conversations WHERE text IS NOT NULL")
def two_deliveries(spark, d):
    """Lengths of turns that are kept: the second delivery adds conversations and changes others, the rest isn't worked on again."""
    folder, rows = _folder(spark), _t(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    later = rows.withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    for k, given in enumerate((rows.where("conv_id % 2 = 0"), later), 1):
        found = incremental.kept(given.withColumn("fingerprint", F.md5("text")), ["conv_id", "turn"], folder, lambda todo, k=k: todo.select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.lit(k).alias("delivery")))
    return found


# --- runs, unions, projections ----------------------------------------------------------------------------------

_RUNS = [("none", "Clean copy", ""), ("a", "One vowel", "a"), ("ae", "Two vowels", "ae"), ("aeo", "Three vowels", "aeo")]


def _run_totals(spark, d) -> DataFrame:
    swaps = F.array(*(F.struct(F.lit(r).alias("run_id"), F.translate("p_name", v, "479"[: len(v)]).alias("ext")) for r, _, v in _RUNS))
    rows = _t(spark, d, "part").select(F.col("p_name").alias("gt"), F.explode(swaps).alias("x")).select("gt", "x.*")
    return metrics.error_totals(rows, ["run_id"])


def _variants(spark) -> DataFrame:
    rows = [(r, label, i, r != "ae") for i, (r, label, _) in enumerate(_RUNS)] + [("lost", "No result", 9, True)]
    return spark.createDataFrame(rows, "run_id string, label string, seq int, has_image boolean")


_RUN_ROWS = " UNION ALL ".join(f"SELECT '{r}' AS run_id, '{label}' AS label, {i} AS seq, p_name AS gt, translate(p_name, '{v}', '{'479'[: len(v)]}') AS ext FROM part" for i, (r, label, v) in enumerate(_RUNS))
_RUN_TOTALS = f"(SELECT run_id, label, seq, sum(levenshtein(gt, ext)) / sum(length(gt)) AS cer, sum(list_sum(list_transform(range(1, len(string_split(gt, ' ')) + 1), lambda i: CASE WHEN string_split(gt, ' ')[i] <> string_split(ext, ' ')[i] THEN 1 ELSE 0 END))) / sum(len(string_split(gt, ' '))) AS wer FROM ({_RUN_ROWS}) GROUP BY run_id, label, seq)"


@query(f"SELECT run_id, label, seq, printf('%.4f (%.2f%%)', cer, cer * 100) AS cer, printf('%.4f (%.2f%%)', wer, wer * 100) AS wer FROM {_RUN_TOTALS} UNION ALL SELECT 'lost', 'No result', 9, 'N/A', 'N/A'")
def experiment_compare(spark, d):
    return experiments.compare_runs(_variants(spark), _run_totals(spark, d))


@query(f"SELECT run_id, label, seq, printf('%.4f', cer) AS cer, printf('%.4f', wer) AS wer, printf('%.3f', 1 - cer) AS overall_f1 FROM {_RUN_TOTALS} WHERE run_id <> 'ae' UNION ALL SELECT 'lost', 'No result', 9, 'ERROR', 'ERROR', 'ERROR'")
def ablation_table(spark, d):
    totals = stored(_run_totals(spark, d), "runs")
    return experiments.ablation_table(_variants(spark), totals, totals.select("run_id", (1 - F.col("cer")).alias("overall_f1")))


@query("SELECT doc_id, 'document' AS kind FROM documents UNION ALL SELECT doc_id, 'label' FROM labels")
def append_union(spark, d):
    one, two = _t(spark, d, "documents").select("doc_id", F.lit("document").alias("kind")), _t(spark, d, "labels").select("doc_id", F.lit("label").alias("kind"))
    return one.unionByName(two)


@query("SELECT CAST(d.doc_id AS VARCHAR) AS stem, md5(coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, b.text)) AS text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 LEFT JOIN benchmark b ON b.item_id = d.doc_id WHERE coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, b.text) IS NOT NULL")
def sidecar_lookup(spark, d):
    images = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    first = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("stem"), F.lit("toxic").alias("text"))
    other = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("stem"), "text")
    return layout.with_sidecar(images, first, other).withColumn("text", F.md5("text"))


@query("SELECT p_partkey AS seq, p_name AS Headword_Phrase, '' AS Entry_Type, p_type AS POS, p_brand AS Translation_RU, '' AS Literal_Meaning, '' AS Grammar_Notes FROM part")
def json_to_tsv_projection(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.to_json(F.struct(F.col("p_name").alias("headword_phrase"), F.col("p_type").alias("pos"), F.col("p_brand").alias("translation_ru"))).alias("j"))
    schema = ", ".join(f"{k} string" for k in FIELDS)
    return writers.to_tsv_names(rows.select("seq", F.from_json("j", schema).alias("r")).select("seq", "r.*"))


@query("SELECT p_partkey AS seq, p_name || ' (' || p_type || '): ' || substr(p_brand || ' ' || p_name, 1, 50) || CASE WHEN p_size % 2 = 0 THEN ' [lit: ' || p_name || ']' ELSE '' END AS line FROM part ORDER BY p_partkey LIMIT 5")
def console_preview(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("Headword_Phrase"), F.col("p_type").alias("POS"), F.concat("p_brand", F.lit(" "), "p_name").alias("Translation_RU"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("Literal_Meaning"))
    return writers.preview(rows)
