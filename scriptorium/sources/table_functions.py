"""Table functions for SQL: records of items by a model, and what failed, as rows.

    SELECT * FROM extract_records(TABLE(SELECT item, text FROM pages), 'pattern')
    SELECT * FROM extract_records(TABLE(SELECT page, item, text FROM pages) PARTITION BY page ORDER BY (item), 'given')

The table has a column text, and may have content (an image) and page; its other columns are given on with each row. For
each record there is a row (no, seq, the six fields), and for an item that fails one with its error. seq counts the
records of an item, no those of a partition, both from 0; with PARTITION BY items are taken in its order."""

from __future__ import annotations

import json
import re

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schemas import FIELDS
from .extract import model

#: Columns that the function makes or uses; a table's others are given on.
MADE = ("no", "seq", *FIELDS, "error")
USED = ("text", "content", "page")


def records_of(answer: str) -> list[dict[str, str]]:
    """The records of one answer as readers.records_of_answers has them; an error if it is no JSON."""
    found = json.loads(re.sub(r"```$", "", re.sub(r"^```(?:json)?", "", answer.strip())).strip())
    if isinstance(found, dict):
        found = found["entries"] if isinstance(found.get("entries"), list) else [found]
    if not isinstance(found, list):
        raise ValueError("no JSON records")
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return [{k: text(r.get(k)) or ("word" if k == "entry_type" else "") for k in FIELDS} for r in found if isinstance(r, dict)]


class ExtractRecords:
    @staticmethod
    def analyze(items: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        if not items.isTable or not isinstance(items.dataType, StructType) or "text" not in items.dataType.names:
            raise ValueError("extract_records takes a table with a column text")
        if not isinstance(name.value, str):
            raise ValueError("extract_records takes the name of a model")
        model(name.value)  # an unknown name is an error of the query, not of its tasks
        out = StructType()
        for f in items.dataType.fields:
            if f.name not in (*USED, *MADE):
                out = out.add(f.name, f.dataType)
        for c in MADE:
            out = out.add(c, LongType() if c in ("no", "seq") else StringType())
        return AnalyzeResult(schema=out)

    def __init__(self) -> None:
        self.model, self.no = None, 0

    def eval(self, row: Row, name: str):
        given = row.asDict()
        rest = [v for k, v in given.items() if k not in (*USED, *MADE)]
        self.model = self.model or model(name)
        try:
            answer = self.model.extract(given.get("content"), given["text"], given.get("page") or 0)
            if answer is None:
                raise ValueError("no answer")
            found = records_of(answer)
        except Exception as e:  # one bad item must not end the job
            yield (*rest, None, None, *[None] * len(FIELDS), f"{type(e).__name__}: {e}")
            return
        for seq, r in enumerate(x for x in found if x["headword_phrase"]):
            yield (*rest, self.no, seq, *(r[k] for k in FIELDS), None)
            self.no += 1


def register(spark: SparkSession) -> SparkSession:
    spark.udtf.register("extract_records", udtf(ExtractRecords))
    return spark
