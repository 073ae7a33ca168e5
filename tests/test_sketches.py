"""Stored and merged sketches: their word kept, whatever the parts; frequent values of a skewed table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators.sketches import DISTINCT_ERROR, RANK_ERROR, frequent, merged, stored


@pytest.mark.parametrize("parts", [1, 30])
def test_merged_sketches_keep_their_word(spark, parts):
    df = spark.range(60_000).select((F.col("id") % parts).alias("day"), F.lit(1).alias("month"), (F.col("id") * 7 % 25_000).alias("who"), (F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    row = merged(stored(df, ["month", "day"], "who", "x"), ["month"]).select("parts", "n", F.hll_sketch_estimate("distinct").alias("who"), F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, (0.1, 0.5, 0.99)))).alias("q")).first()
    assert (row["parts"], row["n"]) == (parts, 60_000)
    assert abs(row["who"] / 25_000 - 1) <= DISTINCT_ERROR
    x = np.sort(df.select("x").toPandas()["x"].to_numpy())
    for want, got in zip((0.1, 0.5, 0.99), row["q"], strict=True):
        assert abs(np.searchsorted(x, got) / len(x) - want) <= 2 * RANK_ERROR


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, 5, 2.0)], "day int, who int, x double")
    row = merged(stored(df, ["day"], "who", "x"), []).select("n", F.hll_sketch_estimate("distinct"), F.kll_sketch_get_n_double("quantiles")).first()
    assert tuple(row) == (2, 1, 1)
    assert merged(stored(df.limit(0), ["day"], "who", "x"), ["day"]).count() == 0


def test_frequent_values_of_a_skewed_table(spark):
    """Two values with a third and a fifth of the rows among many rare ones, with far fewer counters than values."""
    n = 30_000
    value = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 5 == 0, -2).otherwise(F.col("id"))
    df = spark.range(n).select((F.col("id") % 10).alias("day"), value.alias("v"))
    got = {r["item"]: r["n"] for r in frequent(df, ["day"], "v", 2, 256).collect()}
    want = {-1: n // 3, -2: sum(k % 5 == 0 and k % 3 > 0 for k in range(n))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= n / (0.75 * 256) for k in want)
