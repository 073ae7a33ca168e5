"""User-defined functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jvm import register_aggregator
from ..functions.udfs import Sessions, Words, demeaned, discounted, doubled, flags, known, log_sum, matched
from ..sources.tables import table
from .registry import register
from .streams import SESSIONS


@register("i1_pandas_udf", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45")
def pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", discounted("l_extendedprice", "l_discount").alias("net"))


@register("i1_arrow_udf", "SELECT lower(l_returnflag || '/' || l_linestatus) AS flags, count(*) AS n FROM lineitem GROUP BY 1")
def arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).select(flags("l_returnflag", "l_linestatus").alias("flags"), "n")


@register("i2_pandas_aggregate", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS mean FROM part GROUP BY p_brand")
def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas aggregate takes a group's rows as one series, so a brand's parts come some at a time: those of 4,096 keys
    are one series at most. The sums of the logarithms are then added."""
    some = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 4096).alias("some"))
    sums = some.agg(log_sum("p_retailprice").alias("logs"), known("p_retailprice").alias("n"))
    return sums.groupBy("p_brand").agg(F.round(F.exp(F.sum("logs") / F.sum("n")), 4).alias("mean"))


@register("i6_jvm_aggregator", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS mean FROM part GROUP BY p_brand")
def jvm_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a typed aggregator in the JVM: each task has a buffer for a brand, and only those are shuffled."""
    register_aggregator(spark, "geometric_mean", "GeometricMean")
    means = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.expr("geometric_mean(p_retailprice)").alias("mean"))
    return means.select("p_brand", F.round("mean", 4).alias("mean"))


@register("i3_grouped_map", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS distance FROM lineitem WHERE l_quantity > 40")
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame has the lines of 256 orders: their number is the orders' own, however many orders there are, and a frame for
    each order would cost more than its work."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    made = lines.groupBy(F.floor(F.col("l_orderkey") / 256).alias("some")).applyInPandas(demeaned, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, distance double")
    return made.withColumn("distance", F.round("distance", 6))


@register(
    "i3_cogrouped_map",
    "SELECT coalesce(o.k, l.k) AS order_key, coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS lines FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) o FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity = 50 GROUP BY 1) l USING (k)",
)
def cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 orders and their lines at a time."""
    some = lambda key: F.floor(F.col(key) / 256).alias("some")
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_orderkey").groupBy(some("o_orderkey"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select("l_orderkey").groupBy(some("l_orderkey"))
    return orders.cogroup(lines).applyInPandas(matched, "order_key long, orders long, lines long")


@register("i4_map_in_arrow", "SELECT event_id, value * 2 AS twice FROM events")
def map_in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").mapInArrow(doubled, "event_id long, twice double")


@register("i5_table_function", "SELECT item_id, word, CAST(place - 1 AS INT) AS place FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS place FROM benchmark) WHERE word <> ''")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("words_of", Words)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return spark.sql("SELECT item_id, word, place FROM benchmark, LATERAL words_of(text)")


@register("i5_table_argument", SESSIONS)
def table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over a table, a user's events in the order of their times: its sessions are those of h3."""
    spark.udtf.register("sessions_of", Sessions)
    table(spark, sf_dir, "events").select("user_id", "ts").createOrReplaceTempView("events_in_order")
    return spark.sql("SELECT * FROM sessions_of(rows => TABLE(events_in_order) PARTITION BY user_id ORDER BY ts, key => 'user_id', at => 'ts', minutes => 30)")
