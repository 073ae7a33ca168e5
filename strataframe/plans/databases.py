"""A database as source and sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import jdbc
from ..sources.tables import table
from .registry import register


def _orders(spark: SparkSession, sf_dir: str) -> jdbc.Database:
    database = jdbc.shared_database(spark)
    jdbc.write(table(spark, sf_dir, "orders"), database, "ORDERS")
    return database


@register("a7_jdbc_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def jdbc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to a database and read back in parts by their key."""
    back = jdbc.read(spark, _orders(spark, sf_dir), "ORDERS", "o_orderkey")
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@register("a7_jdbc_pushed_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def jdbc_pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database filters and sends two columns."""
    back = jdbc.read(spark, _orders(spark, sf_dir), "ORDERS", "o_orderkey")
    return back.filter("o_totalprice > 300000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@register("a7_jdbc_pushed_aggregate", "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def jdbc_pushed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database groups: a row for each status comes over the connection."""
    name = jdbc.catalog(spark, _orders(spark, sf_dir), f"orders_{uuid.uuid4().hex[:8]}")
    kept = spark.table(f"{name}.APP.ORDERS").filter("o_totalprice > 100000")
    made = kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"), F.sum("o_totalprice").alias("total"))
    return made.withColumn("total", F.round("total", 2))
