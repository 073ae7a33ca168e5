"""Samples of a fixed size, of the whole table or of each stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, by: list[str], key: str, k: int, seed: int) -> DataFrame:
    """df's k rows of the smallest hashes of seed and key, of each stratum (or of all rows without by); all of a stratum that
    has fewer. Uniform without replacement, and the same on every run.

    Samples of parts merge by their hashes: every task keeps its own k of a stratum and only those are shuffled
    (WindowGroupLimit, TakeOrderedAndProject), so a stratum with most rows costs no task more than k rows of each other
    task. Null keys have a hash too; rows of one key are ordered by chance.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))
    if not by:
        return hashed.orderBy("_hash", key).limit(k).drop("_hash")
    w = Window.partitionBy(*by).orderBy("_hash", key)
    return hashed.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= k).drop("_hash", "_nth")
