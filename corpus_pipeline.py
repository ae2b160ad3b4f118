"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; one document of each near-duplicate group stays; repeated passages are cut out of all but their first
document; contaminated documents go; the rest is tokenised and packed.

Defined cases: a null or empty text passes the filters and is packed as the end token alone. Rows without doc_id, or with
one that others share, are documents of their own, each judged by its own text and cut where another one has its passages;
of equal or near texts the one with the least doc_id stays, and without any one of them. Ties and repeated rows are near-duplicates like others. Texts of any
length are read whole. An empty table gives an empty result. All stages but the last keep every column of documents,
whatever its name; the last gives pieces and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import discard, settled, table
from scriptorium.llm.decontaminate import stage_decontaminate
from scriptorium.llm.jaccard_join import stage_jaccard_join
from scriptorium.llm.packing import stage_packing
from scriptorium.llm.substring_dedup import stage_substring_dedup
from scriptorium.llm.toxicity import stage_toxicity

#: Each takes (spark, docs, sf_dir) and returns what it keeps.
STAGES = [
    ("toxicity", stage_toxicity),
    ("jaccard_join", stage_jaccard_join),
    ("substring_dedup", stage_substring_dedup),
    ("decontamination", stage_decontaminate),
    ("packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is stored, and what it has stored on the way goes, as does the result before it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = settled(stage)(spark, docs, sf_dir)
        if before is not None:
            discard(before)
        before = docs
    return docs


#: Tokenisation and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
