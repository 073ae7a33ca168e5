"""Ranks, frames and running values by range partitions against Spark's own window functions."""

from __future__ import annotations

import contextlib
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.operators.scans import _carried, carried, cume_dist, ntile, percent_rank, ranks, spans

few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
rows_of = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.sampled_from([0.0, -0.0, float("nan"), 1.0, 2.0, 3.0]))), max_size=60)


def _same(got, want):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def _ranked_both_ways(df, direction):
    got = ranks(df, ["k"], [(F.col("v"), direction)], [F.col("i")])
    got = got.select("i", "_row", "_rank", "_dense", F.round(percent_rank(), 9), F.round(cume_dist(), 9), ntile(4), "_rows")
    w = Window.partitionBy("k").orderBy(direction(F.col("v")))
    wi = Window.partitionBy("k").orderBy(direction(F.col("v")), "i")
    want = df.select("i", F.row_number().over(wi), F.rank().over(w), F.dense_rank().over(w), F.round(F.percent_rank().over(w), 9), F.round(F.cume_dist().over(w), 9), F.ntile(4).over(wi), F.count("*").over(Window.partitionBy("k")))
    return got, want


@few
@given(rows_of, st.sampled_from(["asc", "desc", "desc_nulls_first"]))
def test_ranks_equal_windows(spark, rows, direction):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k int, v double, i long")
    _same(*_ranked_both_ways(df, lambda x: getattr(x, direction)()))


@pytest.mark.parametrize("values", [1, 3, 400])
def test_one_group_of_all_rows(spark, values):
    """Values that lie in several range partitions too."""
    df = spark.range(2_000).select(F.lit(7).alias("k"), (F.col("id") * 7919 % values).cast("double").alias("v"), F.col("id").alias("i"))
    _same(*_ranked_both_ways(df, lambda x: x.asc()))


def test_no_partition_holds_the_group(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put small partitions together
    try:
        sizes = [r["n"] for r in ranks(df, ["k"], [F.col("v")]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 15_000
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        ranks(df, ["k"], [F.col("v")]).explain("formatted")
    assert "_part" in out.getvalue()
    assert all("_part" in line for line in out.getvalue().splitlines() if "hashpartitioning" in line)


def test_without_groups_and_two_columns(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), F.col("id").alias("i"))
    got = ranks(df, [], [(F.col("a"), lambda x: x.desc()), F.col("b")], [F.col("i")]).select("i", "_row", "_rank", "_dense", "_upto")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("a"), "b")
    _same(got, df.select("i", F.row_number().over(w.orderBy(F.desc("a"), "b", "i")), F.rank().over(w), F.dense_rank().over(w), F.count("*").over(w)))


def test_a_group_of_text_keys_beside_null(spark):
    df = spark.createDataFrame([("None" if i % 2 else None, i) for i in range(200)], "k string, v long")
    _same(ranks(df, ["k"], [F.col("v")]).select("k", "v", "_row"), df.select("k", "v", F.row_number().over(Window.partitionBy("k").orderBy("v"))))


def test_what_is_carried_over_partitions_of_one_value():
    a, b = (1.0,), (2.0,)
    assert _carried([(a, b, 3, 2, 2, 1), (b, b, 4, 1, 4, 4), (b, b, 2, 1, 2, 2)]) == [(0, 0, None, 6, 9), (3, 2, 3, 2, 9), (7, 2, 3, 0, 9)]


@few
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 1)), st.one_of(st.none(), st.integers(0, 5))), max_size=60))
def test_spans_equal_windows(spark, rows):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k int, v int, i long")
    view = F.when(F.col("v") == 0, F.col("i"))
    cut = carried(spans(df, ["k"], [F.col("i")], size=7, before=3, after=2), ["k"], {"so_far": F.col("i")}, {"last": view}, {"second": (F.col("v"), 2)})
    w = Window.partitionBy("k", "_span").orderBy("_row")
    running, own = w.rowsBetween(Window.unboundedPreceding, 0), F.col("_own")
    got = cut.select(
        "i", "_own", F.lag("i", 3).over(w), F.lead("i", 2).over(w), F.sum("i").over(w.rowsBetween(-2, 0)), F.max("i").over(w.rowsBetween(1, 2)),
        F.coalesce("so_far", F.lit(0)) + F.sum(F.when(own, F.col("i"))).over(running), F.coalesce(F.last(F.when(own, view), True).over(running), "last"), "second",
    )
    w = Window.partitionBy("k").orderBy("i")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "i", F.lit(True), F.lag("i", 3).over(w), F.lead("i", 2).over(w), F.sum("i").over(w.rowsBetween(-2, 0)), F.max("i").over(w.rowsBetween(1, 2)),
        F.sum("i").over(running), F.last(view, True).over(running), F.nth_value("v", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    _same(got.filter("_own"), want)


def test_a_frame_beyond_its_neighbours_is_refused(spark):
    with pytest.raises(ValueError, match="frame"):
        spans(spark.range(3).withColumn("k", F.lit(1)), ["k"], [F.col("id")], size=2, before=3)
