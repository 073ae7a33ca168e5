"""Sketches that are stored as a table and merged: distinct counts, quantiles and frequent values.

A sketch of a part (a day, say) is a few KB whatever the part's size, and sketches of parts merge into that of their
union, so figures of longer spans come from the stored table without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Registers of a distinct-count sketch, as a power of two, and three deviations of its estimate.
LOG_REGISTERS, DISTINCT_ERROR = 14, 3 * 1.04 / 2**7
#: Size of a quantile sketch, and how far a rank may be off (stated for that size with 99 % confidence).
QUANTILES, RANK_ERROR = 800, 0.0035


def stored(df: DataFrame, parts: list[str], counted: str, measured: str) -> DataFrame:
    """parts, n, distinct (of counted) and quantiles (of measured) of each part, as a written table. Nulls are in no sketch."""
    made = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(counted, LOG_REGISTERS).alias("distinct"), F.kll_sketch_agg_double(F.col(measured).cast("double"), QUANTILES).alias("quantiles"))
    return written(made, "sketches")


def merged(sketches: DataFrame, into: list[str]) -> DataFrame:
    """into (some of the parts), parts (how many were merged), n, distinct and quantiles."""
    return sketches.groupBy(*into).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def frequent(df: DataFrame, parts: list[str], item: str, k: int, counters: int) -> DataFrame:
    """item, n: the k most frequent values, from counters of each part that are merged. Where there are no more different
    values than counters, n is exact; else a value of n rows is off by less than all rows / (0.75 counters)."""
    kept = df.groupBy(*parts).agg(F.expr(f"approx_top_k_accumulate({item}, {counters})").alias("state"))
    top = kept.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {counters}), {k})").alias("top"))
    return top.select(F.explode("top").alias("t")).select("t.item", F.col("t.count").alias("n"))
