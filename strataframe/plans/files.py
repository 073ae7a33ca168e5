"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import avro
from ..sources.files import read, round_trip, write
from ..sources.scratch import shared_folder
from ..sources.tables import table
from .registry import register

_EVENTS = "SELECT event_id, user_id, event_type, round(value, 4) AS value, ts, props FROM events"


def _round_trip(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").withColumn("value", F.round("value", 4))
        return round_trip(events, shared_folder(spark, kind), kind).select("event_id", "user_id", "event_type", "value", "ts", "props")

    return query


for _kind in ("parquet", "orc", "csv", "json", "xml"):
    register(f"a2_{_kind}_round_trip", _EVENTS)(_round_trip(_kind))


@register("a1_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_totalprice > 400000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@register("a2_text_round_trip", "SELECT upper(n_name) AS name, count(*) AS n FROM nation GROUP BY 1")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "text")
    table(spark, sf_dir, "nation").select("n_name").write.text(at)
    return spark.read.text(at).groupBy(F.upper("value").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@register("a3_binary_files", "SELECT CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(r_name) + 1) AS BIGINT) AS n_bytes FROM region")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "binary")
    table(spark, sf_dir, "region").select("r_name").write.text(at)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).filter("length > 0")
    text = F.decode("content", "UTF-8")
    return files.select(F.regexp_count(text, F.lit("\n")).alias("lines"), "length").agg(F.sum("lines").cast("long").alias("n_lines"), F.sum("length").alias("n_bytes"))


@register("a4_avro_round_trip", _EVENTS)
def avro_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in Avro containers, read back in splits of 64 KB."""
    avro.register(spark)
    events, at = table(spark, sf_dir, "events").withColumn("value", F.round("value", 4)), shared_folder(spark, "avro")
    events.write.format("avro_container").mode("append").save(at)
    return spark.read.format("avro_container").option("splitBytes", 1 << 16).load(at).select("event_id", "user_id", "event_type", "value", "ts", "props")


@register("a5_inline_rows", "SELECT name, count(o_orderkey) AS n, max(weight) AS weight FROM (VALUES ('1-URGENT', 'urgent', 1.5::DOUBLE), ('5-LOW', 'low', NULL), ('6-NONE', NULL, 3.5)) t(k, name, weight) LEFT JOIN orders ON o_orderpriority = k GROUP BY name")
def inline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the query itself, with nulls, beside a table."""
    named = spark.createDataFrame([("1-URGENT", "urgent", 1.5), ("5-LOW", "low", None), ("6-NONE", None, 3.5)], "k string, name string, weight double")
    orders = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("o_orderkey").alias("n"))
    made = named.join(orders, F.col("k") == F.col("o_orderpriority"), "left")
    return made.groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("weight").alias("weight"))


@register("a5_range", "SELECT k * 50000 AS begins, count(o_orderkey) AS n FROM range(0, 12) r(k) LEFT JOIN orders ON floor(o_totalprice / 50000) = k GROUP BY k")
def number_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps made by range(), the empty ones too, with the orders in each."""
    orders = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 50_000).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(0, 12).join(orders, "id", "left").select((F.col("id") * 50_000).alias("begins"), F.coalesce("n", F.lit(0)).alias("n"))


@register("a6_partitioned_write", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter prunes folders: only those of two event types are listed in the scan."""
    events, at = table(spark, sf_dir, "events"), shared_folder(spark, "partitioned")
    write(events.repartition("event_type"), at, "parquet", ("event_type",))
    kept = read(spark, at, "parquet", events.schema).filter(F.col("event_type").isin("click", "view"))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("a6_bucketed_table", "SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def bucketed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are bucketed by the join key, so join and grouping need no exchange. The tables
    have names of their own in each run, as the result reads them later; dropped() drops those of a session."""
    names, mark = {}, uuid.uuid4().hex[:8]
    for source, key in (("orders", "o_custkey"), ("customer", "c_custkey")):
        names[source] = f"{source}_by_customer_{mark}"
        table(spark, sf_dir, source).select(key).write.bucketBy(8, key).sortBy(key).saveAsTable(names[source])
    orders, customer = (spark.table(names[x]) for x in ("orders", "customer"))
    joined = orders.hint("merge").join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def dropped(spark: SparkSession) -> int:
    """Drops the tables that a6_bucketed_table made, and tells how many."""
    found = [t.name for t in spark.catalog.listTables() if "_by_customer_" in t.name and not t.isTemporary]
    for name in found:
        spark.sql(f"DROP TABLE {name} PURGE")
    return len(found)
