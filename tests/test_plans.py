"""The physical plans that the engine counts on."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from strataframe.operators.ranges import band_join
from strataframe.plans import registry
from strataframe.sources.tables import SCHEMAS, table

QUERIES = registry.queries()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    got = plan(QUERIES["a1_parquet_scan"](spark, sf_dir))
    assert "GreaterThan(o_totalprice,400000.0)" in got and "EqualTo(o_orderstatus,F)" in got
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in got


def test_top_k_keeps_its_rows_in_each_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["f3_top_k"](spark, sf_dir))
    assert "WindowGroupLimit" in plan(QUERIES["e6_top_n_of_each"](spark, sf_dir))


def test_bucketed_sides_join_without_exchange(spark, sf_dir):
    spark.conf.set("spark.sql.sources.v2.bucketing.enabled", "true")
    assert "Exchange" not in plan(QUERIES["a6_bucketed_table"](spark, sf_dir))


def test_band_join_has_no_nested_loop(spark):
    a, b = spark.range(100).select(F.col("id").alias("x")), spark.range(100).select(F.col("id").alias("y"))
    got = plan(band_join(a, b, F.col("x"), F.col("y"), 2))
    assert "NestedLoop" not in got and "Cartesian" not in got


def test_hints_choose_the_join(spark, sf_dir):
    for name, node in (("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")):
        assert node in plan(QUERIES[f"c6_{name}_hint"](spark, sf_dir))


def test_declared_schemas_are_those_of_the_files(spark, sf_dir):
    for name in SCHEMAS:
        files = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        assert [(f.name, f.dataType) for f in table(spark, sf_dir, name).schema] == [(f.name, f.dataType) for f in files]


def test_not_in_broadcasts_no_unbounded_side(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("b6_not_in", "b6_not_in_with_null", "c4_null_aware_anti_join"):
            got = plan(QUERIES[name](spark, sf_dir))
            assert "SortMergeJoin" in got and "LeftAnti" in got and "Broadcast" not in got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_global_sort_is_by_ranges(spark, sf_dir):
    assert "rangepartitioning" in plan(QUERIES["f1_sort"](spark, sf_dir)) and "TakeOrdered" not in plan(QUERIES["f1_sort"](spark, sf_dir))


def test_the_jvm_aggregator_keeps_a_buffer_in_each_task(spark, sf_dir):
    got = plan(QUERIES["i6_jvm_aggregator"](spark, sf_dir))
    assert "partial_geometricmean" in got.lower().replace("_$", "") or got.count("ObjectHashAggregate") >= 2
    assert "Python" not in got and "Pandas" not in got


def test_ranks_have_no_window_by_the_group_alone(spark, sf_dir):
    for name, key in (("e1_ranks", "c_nationkey"), ("e2_distribution", "s_nationkey"), ("e3_offsets", "user_id"), ("e4_row_frames", "user_id"), ("e5_range_frame", "user_id")):
        got = plan(QUERIES[name](spark, sf_dir))
        assert f"hashpartitioning({key}" in got
        for line in got.splitlines():
            if "hashpartitioning(" in line and "Exchange" not in line and f"({key}" in line:
                assert line.count(",") >= 3, (name, line)  # the key with a partition or span


def test_a_jvm_aggregator_of_nulls_and_no_rows(spark):
    from strataframe.functions.jvm import register_aggregator

    register_aggregator(spark, "geometric_mean", "GeometricMean")
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (1, None), (2, None)], "k int, x double")
    assert {r["k"]: r["m"] for r in df.repartition(3).groupBy("k").agg(F.expr("geometric_mean(x)").alias("m")).collect()} == {1: 4.0, 2: None}
