"""Window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.scans import carried, cume_dist, ntile, percent_rank, ranks, spans, time_spans
from ..sources.tables import table
from .registry import register, register_sql


def _down(c: Column) -> Column:
    return c.desc()


@register(
    "e1_ranks",
    """
    SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place,
      CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS ranked, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS dense
    FROM customer
    """,
)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of each nation's customers, each by range partitions: 25 nations are as many tasks as their rows need."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    by_balance = ranks(customers, ["c_nationkey"], [(F.col("c_acctbal"), _down)], [F.col("c_custkey")]).select("c_custkey", "c_nationkey", "c_mktsegment", F.col("_row").alias("place"))
    return ranks(by_balance, ["c_nationkey"], [F.col("c_mktsegment")]).select("c_custkey", "place", F.col("_rank").alias("ranked"), F.col("_dense").alias("dense"))


@register(
    "e2_distribution",
    """
    SELECT s_suppkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd
    FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)
    """,
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    placed = ranks(suppliers, ["s_nationkey"], [F.col("s_acctbal"), F.col("s_suppkey")])
    return placed.select("s_suppkey", ntile(4).alias("quarter"), F.round(percent_rank(), 8).alias("pr"), F.round(cume_dist(), 8).alias("cd"))


def _in_order() -> WindowSpec:
    return Window.partitionBy("user_id", "_span").orderBy("_row")


def _by_user(spark: SparkSession, sf_dir: str, before: int = 0, after: int = 0) -> DataFrame:
    """A user's events in spans: one who has all events is many tasks' work."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return spans(events, ["user_id"], [F.col("ts"), F.col("event_id")], before=before, after=after)


@register(
    "e3_offsets",
    """
    SELECT event_id, lag(event_id) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(event_id) OVER w AS first_id,
      nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carried(_by_user(spark, sf_dir, 1, 2), ["user_id"], firsts={"first_id": (F.col("event_id"), 1), "second_type": (F.col("event_type"), 2)})
    made = rows.select("event_id", F.lag("event_id").over(_in_order()).alias("before"), F.lead("value", 2, -1.0).over(_in_order()).alias("after"), "first_id", "second_type", "_own")
    return made.filter("_own").drop("_own")


@register("e3_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events")
def ignore_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view in the span so far, or else the one that the user had before it."""
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    rows = carried(_by_user(spark, sf_dir), ["user_id"], lasts={"earlier": view})
    here = F.last(view, ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("event_id", F.coalesce(here, "earlier").alias("last_view"))


@register(
    "e4_row_frames",
    """
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving,
      count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_so_far,
      max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_most
    FROM events
    """,
)
def row_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_user(spark, sf_dir, 2, 3)
    made = rows.select("event_id", F.round(F.sum("value").over(_in_order().rowsBetween(-2, 0)), 4).alias("moving"), F.col("_row").alias("n_so_far"), F.max("value").over(_in_order().rowsBetween(1, 3)).alias("next_most"), "_own")
    return made.filter("_own").drop("_own")


@register(
    "e4_running_totals",
    "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM events",
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five types hold all events: totals of the spans before are carried into each."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("value").cast("decimal(20,6)").alias("value"))
    rows = carried(spans(events, ["event_type"], [F.col("ts"), F.col("event_id")]), ["event_type"], totals={"earlier": F.col("value")})
    here = F.sum("value").over(Window.partitionBy("event_type", "_span").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("event_id", F.round((here + F.coalesce("earlier", F.lit(0))).cast("double"), 2).alias("total"))


@register(
    "e5_range_frame",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events",
)
def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's spans of six hours, each with the hour before it."""
    hour = 3_600_000_000
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    rows = time_spans(events, ["user_id"], F.col("micros"), 6 * hour, hour)
    w = Window.partitionBy("user_id", "_span").orderBy("_at").rangeBetween(-hour, Window.currentRow)
    return rows.select("event_id", F.count(F.lit(1)).over(w).alias("in_hour"), "_own").filter("_own").drop("_own")


@register(
    "e6_top_n_of_each",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
)
def top_n_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WindowGroupLimit: each task drops all but three rows of a key before the exchange."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@register("e7_filter_on_window", "SELECT c_nationkey, c_custkey FROM customer QUALIFY c_acctbal > 1.8 * avg(c_acctbal) OVER (PARTITION BY c_nationkey)")
def filter_on_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a group's mean needs no window: the means, one row a nation, are joined."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    means = customers.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    return customers.join(means, "c_nationkey").filter("c_acctbal > 1.8 * mean").select("c_nationkey", "c_custkey")


register_sql(
    "e8_share_of_total",
    "SELECT l_suppkey, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 8) AS share FROM lineitem GROUP BY l_suppkey",
)
