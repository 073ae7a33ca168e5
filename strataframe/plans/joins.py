"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.antijoin import not_in
from ..operators.asof import asof_join
from ..operators.ranges import band_join, interval_join
from ..operators.salting import salted_join
from ..sources.tables import table
from .registry import register, register_sql

register_sql("c1_inner_join", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000")
_BIG, _RICH = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 350000) o", "(SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000) c"
for _how in ("left", "right", "full"):
    register_sql(f"c2_{_how}_outer_join", f"SELECT o_orderkey, c_custkey, c_acctbal FROM {_BIG} {_how.upper()} OUTER JOIN {_RICH} ON o_custkey = c_custkey")


@register("c3_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity = 50")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@register("c3_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")




@register("c4_null_aware_anti_join", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT CASE WHEN c_acctbal > 9900 THEN c_nationkey ELSE -1 END FROM customer)")
def null_aware_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 9900, F.col("c_nationkey")).otherwise(-1).alias("k"))
    return not_in(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", rich).select("s_suppkey")


register_sql("c5_theta_join", "SELECT s_suppkey, r_regionkey FROM supplier JOIN region ON s_nationkey > r_regionkey * 5 AND s_acctbal > 1000 * r_regionkey")
register_sql("c5_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")


def _hinted(hint: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        joined = lines.join(table(spark, sf_dir, "part").hint(hint), F.col("l_partkey") == F.col("p_partkey"))
        return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

    return query


# part is the side that Spark would broadcast only below its threshold; the other two hints hold at any size
for _hint in ("merge", "shuffle_hash", "broadcast"):
    register(f"c6_{_hint}_hint", "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")(_hinted(_hint))


def _seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


@register(
    "c7_asof_join",
    """
    SELECT e.event_id, e.user_id, e.ts, p.event_id AS last_event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts
    """,
)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest view; a user's days are apart, so one of many events is many tasks' work."""
    events = table(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return asof_join(purchases, views, ["user_id"], "ts", prefix="last_", tie="event_id", span=lambda t: F.unix_date(F.to_date(t))).select("event_id", "user_id", "ts", "last_event_id", "last_value")


@register(
    "c8_band_join",
    """
    SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id
    AND abs(epoch_us(a.ts) / 1e6 - epoch_us(b.ts) / 1e6) <= 600 WHERE a.event_type = 'click' AND b.event_type = 'purchase'
    """,
)
def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of a user within ten minutes of each other."""
    events = table(spark, sf_dir, "events")
    side = lambda kind, k: events.filter(F.col("event_type") == kind).select(F.col("event_id").alias(k), F.col("user_id").alias(f"user_{k}"), _seconds("ts").alias(f"at_{k}"))
    return band_join(side("click", "a"), side("purchase", "b"), F.col("at_a"), F.col("at_b"), 600, [("user_a", "user_b")]).select("a", "b")


@register(
    "c8_interval_join",
    """
    SELECT o_orderkey, event_id FROM events JOIN (SELECT o_orderkey, 1704067200 + o_orderkey * 60 AS begin_at, 1704067200 + o_orderkey * 60 + 90 AS end_at FROM orders WHERE o_totalprice > 300000) o
    ON epoch_us(ts) / 1e6 >= begin_at AND epoch_us(ts) / 1e6 < end_at
    """,
)
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", _seconds("ts").alias("at"))
    begin = F.lit(1704067200) + F.col("o_orderkey") * 60
    spans = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_orderkey", begin.alias("begin_at"), (begin + 90).alias("end_at"))
    return interval_join(events, spans, F.col("at"), F.col("begin_at"), F.col("end_at"), 90).select("o_orderkey", "event_id")


register_sql(
    "c9_lateral_join",
    "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t WHERE c_acctbal > 8000",
)


@register(
    "c10_self_join",
    "SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(b.s_acctbal - a.s_acctbal, 2) AS more FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
)
def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of suppliers of a nation. There are few nations and the rows grow as the square, so each nation's left rows
    are dealt out over tasks of a set number, since Spark would merge them by their small size. The hint keeps it from
    broadcasting the repeated side, which it takes to be as small as before."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    deals = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a = s.toDF("a", "nation", "a_acctbal").withColumn("deal", F.pmod(F.xxhash64("a"), F.lit(deals)).cast("int"))
    b = s.toDF("b", "nation", "b_acctbal").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = [x.repartition(deals, "deal", "nation") for x in (a, b)]
    pairs = dealt[0].join(dealt[1].hint("merge"), ["deal", "nation"]).filter("a < b")
    return pairs.select("a", "b", F.round(F.col("b_acctbal") - F.col("a_acctbal"), 2).alias("more"))


@register("c11_salted_join", "SELECT event_type, name, count(*) AS n FROM events JOIN (VALUES ('click', 'pointer'), ('view', 'page'), ('purchase', 'shop')) v(kind, name) ON event_type = kind GROUP BY event_type, name")
def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys hold all rows, so each key's rows are dealt out over sixteen tasks."""
    names = spark.createDataFrame([("click", "pointer"), ("view", "page"), ("purchase", "shop")], "event_type string, name string")
    joined = salted_join(table(spark, sf_dir, "events").select("event_type", "event_id"), names, "event_type", 16, F.col("event_id"))
    return joined.groupBy("event_type", "name").agg(F.count(F.lit(1)).alias("n"))
