"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantile, exact_quantiles
from ..operators.salting import salted_distinct_count
from ..operators.sketches import DISTINCT_ERROR, RANK_ERROR, frequent, merged, stored
from ..sources.tables import table
from .registry import register, register_sql

register_sql(
    "d1_aggregates",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_shipdate) AS first_ship, max(l_discount) AS most, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag",
)
register_sql("d2_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey, l_linenumber) AS keys FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_orderkey, l_linenumber)) AS keys FROM lineitem GROUP BY l_returnflag")
register_sql("d3_filter_clause", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 200000), 2) AS large FROM orders GROUP BY o_orderpriority")
register_sql("d4_rollup", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
register_sql("d5_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
register_sql("d6_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
register_sql(
    "d7_statistics",
    """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS v, round(corr(l_quantity, l_extendedprice), 6) AS r,
      round(covar_samp(l_quantity, l_tax), 6) AS cov, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem GROUP BY l_returnflag
    """,
)
register_sql("d7_one_row", "SELECT r_name, stddev_samp(CAST(r_regionkey AS DOUBLE)) AS sd, var_pop(CAST(r_regionkey AS DOUBLE)) AS v FROM region GROUP BY r_name")


@register("d8_percentiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS high FROM lineitem GROUP BY l_returnflag")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, by ranks over range partitions, both columns in one pass: no buffer holds the values of a group."""
    both = exact_quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", {"middle": ("l_quantity", 0.5), "high": ("l_extendedprice", 0.9)})
    return both.select("l_returnflag", "middle", F.round("high", 4).alias("high"))


register_sql("d8_percentile_function", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.25), 4) AS low, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS low, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY o_orderpriority")


@register("d9_sketches")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts and quantiles; another engine's sketches give other estimates, so it has no SQL."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("about_parts"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("about_orders"),
        F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("about_middle"),
    )


def _within(estimate: str, exact: str, by: float) -> Column:
    """The exact figure where the estimate is as near to it as its sketch promises, else the estimate."""
    e, x = F.col(estimate).cast("double"), F.col(exact).cast("double")
    return F.when(F.abs(e - x) <= F.lit(by) * x, x).otherwise(e)


@register(
    "d9_sketch_errors",
    "SELECT l_returnflag, count(DISTINCT l_partkey)::DOUBLE AS parts, count(DISTINCT l_orderkey)::DOUBLE AS orders, round(quantile_cont(l_extendedprice, 0.5), 4) AS middle FROM lineitem GROUP BY l_returnflag",
)
def sketch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact figures, as far as the estimates lie within three deviations (0.02 and 0.016) of the counts, and a hundredth of the middle."""
    lines = table(spark, sf_dir, "lineitem")
    exact = salted_distinct_count(lines, "l_returnflag", "l_partkey", "parts").join(salted_distinct_count(lines, "l_returnflag", "l_orderkey", "orders"), "l_returnflag")
    exact = exact.join(exact_quantile(lines, "l_returnflag", "l_extendedprice", 0.5, "middle"), "l_returnflag")
    both = sketches(spark, sf_dir).join(exact, "l_returnflag")
    return both.select("l_returnflag", _within("about_parts", "parts", 0.06).alias("parts"), _within("about_orders", "orders", 0.05).alias("orders"), F.round(_within("about_middle", "middle", 0.01), 4).alias("middle"))


@register(
    "d9_merged_sketches",
    "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(DISTINCT o_orderdate) AS days, count(*) AS n, count(DISTINCT o_custkey)::DOUBLE AS customers, round(quantile_cont(o_totalprice, 0.5), 4) AS middle FROM orders GROUP BY 1",
)
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day are stored and merged up to months; the exact figures stand where the merged sketches keep their word."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.trunc(F.to_date("o_orderdate"), "month"))
    months = merged(stored(orders, ["month", "o_orderdate"], "o_custkey", "o_totalprice"), ["month"])
    exact = salted_distinct_count(orders, "month", "o_custkey", "customers").join(exact_quantile(orders, "month", "o_totalprice", 0.5, "middle"), "month")
    both = months.join(exact, "month").withColumn("about", F.hll_sketch_estimate("distinct"))
    low, about, high = (F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5 + off)) for off in (-RANK_ERROR, 0.0, RANK_ERROR))
    middle = F.when(F.col("middle").between(low, high), F.col("middle")).otherwise(about)
    return both.select("month", F.col("parts").alias("days"), F.kll_sketch_get_n_double("quantiles").alias("n"), _within("about", "customers", DISTINCT_ERROR).alias("customers"), F.round(middle, 4).alias("middle"))


@register("d9_heavy_hitters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent types by counters of each day that are merged; more counters than types, so exact."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return frequent(events, ["day"], "event_type", 5, 64).select(F.col("item").alias("event_type"), "n")


register_sql("d10_collect", "SELECT c_nationkey, array_join(sort_array(collect_set(c_mktsegment)), ',') AS segments, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest, min_by(c_name, struct(c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, max_by(c_custkey, (c_acctbal, c_custkey)) AS richest, min_by(c_name, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey")
register_sql("d10_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
register_sql("d10_any_every", "SELECT o_orderstatus, bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 0) AS every_one, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")


@register("d11_bitmap_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def bitmap_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts of dense ids by bitmaps: one for each bucket of ids, then their sums."""
    bits = table(spark, sf_dir, "events").groupBy("event_type", F.bitmap_bucket_number("user_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("bits"))
    return bits.groupBy("event_type").agg(F.sum(F.bitmap_count("bits")).alias("users"))


register_sql("d12_no_rows", "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS most FROM orders WHERE o_totalprice < 0")


@register("d13_salted_distinct", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def salted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted_distinct_count(table(spark, sf_dir, "events"), "event_type", "event_id", "n")


register_sql(
    "d14_having",
    "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500 AND sum(l_quantity) > 15000",
)
register_sql("d15_histogram", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
