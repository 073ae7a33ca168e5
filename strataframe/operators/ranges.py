"""Joins on a distance between numbers or times, as equi-joins of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_at: Column, right_at: Column, width: float, by: list[tuple[str, str]] = (), how: str = "inner") -> DataFrame:
    """Pairs with abs(left_at - right_at) <= width, and equal in each pair of columns in by.

    Numbers are put in bins as wide as the band; a right row goes to its own and both adjacent
    bins, so each pair meets in exactly one bin, by an equi-join that Spark can shuffle
    and split like any other. Nulls match nothing. The sides' columns must have different names.
    """
    one = left.withColumns({"_at": left_at.cast("double"), "_bin": F.floor(left_at.cast("double") / F.lit(float(width)))})
    other = F.floor(right_at.cast("double") / F.lit(float(width)))
    two = right.withColumn("_other_at", right_at.cast("double")).withColumn("_other_bin", F.explode(F.array(other - 1, other, other + 1)))
    match = (F.col("_bin") == F.col("_other_bin")) & (F.abs(F.col("_at") - F.col("_other_at")) <= F.lit(float(width)))
    for a, b in by:
        match &= F.col(a) == F.col(b)
    return one.join(two, match, how).drop("_at", "_bin", "_other_at", "_other_bin")


def interval_join(points: DataFrame, intervals: DataFrame, at: Column, begin: Column, end: Column, width: float) -> DataFrame:
    """Pairs with begin <= at < end. An interval goes to every bin of this width that it touches:
    choose the width near the usual length, so that a row goes to a few bins."""
    bin_of = lambda x: F.floor(x.cast("double") / F.lit(float(width)))
    one = points.withColumn("_bin", bin_of(at))
    two = intervals.filter(begin < end).withColumn("_other", F.explode(F.sequence(bin_of(begin), bin_of(end))))
    return one.join(two, (F.col("_bin") == F.col("_other")) & (at >= begin) & (at < end)).drop("_bin", "_other")
