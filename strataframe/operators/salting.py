"""Joins and groupings by keys of which some hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, spread: Column, how: str = "inner") -> DataFrame:
    """left join right on key, each key's left rows dealt out over salts tasks by the hash of
    spread (a column that differs within a key). Right rows go to each of them: right is the
    side with few rows a key. how: inner, left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} can't keep rows of the repeated side")
    one = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    two = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(two, [key, "_salt"], how).drop("_salt")


def salted_distinct_count(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key and the number of its distinct values: by (key, value) first, so that a key's values are
    spread over tasks, then by key with partial sums."""
    return df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias(name))
