"""Numbers in order without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import scanned_by_parts


def numbered_in_order(df: DataFrame, by: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """df with each row's place (from 0) among the rows of equal keys, in order of by; see operators.scan."""
    return scanned_by_parts(df, keys, by, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)
