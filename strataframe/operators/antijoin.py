"""NOT IN, null-aware, without a broadcast of its right side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows of left for which key NOT IN (values, of one column) is true, as SQL has it.

    A null among the values leaves no row, a null key stays only where there are no values. Spark plans
    NOT IN as a broadcast of all values, whatever their size; here nulls are asked for on their own and the
    different values are an anti join, which Spark can sort and merge.
    """
    values = values.toDF("_value")
    has_null = values.filter("_value IS NULL").exists()
    left = left.filter(~has_null & (F.col(key).isNotNull() | ~values.exists()))
    return left.join(values.filter("_value IS NOT NULL").distinct(), F.col(key) == F.col("_value"), "left_anti")
