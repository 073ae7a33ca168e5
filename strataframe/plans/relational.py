"""Projections, filters, subqueries, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.antijoin import not_in
from ..operators.sampling import smallest_hashes
from ..sources.tables import table, views
from .registry import register, register_sql


@register("b1_project", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, upper(l_returnflag) || l_linestatus AS flags FROM lineitem")
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", charge.alias("charge"), F.concat(F.upper("l_returnflag"), "l_linestatus").alias("flags"))


@register("b2_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5 AND (l_returnflag = 'R' OR NOT l_linestatus = 'O') AND l_shipdate >= TIMESTAMP '1998-01-01'")
def comparison_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = (F.col("l_returnflag") == "R") | ~(F.col("l_linestatus") == "O")
    rows = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") < 5) & flags & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@register("b3_predicates", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size BETWEEN 5 AND 20 AND p_name LIKE '%red%' AND p_name NOT LIKE '%bolt' AND p_brand IS NOT NULL")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kept = part.filter(F.col("p_type").isin("ECONOMY", "PROMO") & F.col("p_size").between(5, 20) & F.col("p_name").like("%red%") & ~F.col("p_name").like("%bolt") & F.col("p_brand").isNotNull())
    return kept.select("p_partkey", "p_name", "p_brand")


@register("b3_rlike", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[0-9]*7[0-9]$') AND regexp_matches(c_mktsegment, '^(AUTO|BUILD)')")
def rlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_name").rlike("[0-9]*7[0-9]$") & F.col("c_mktsegment").rlike("^(AUTO|BUILD)")).select("c_custkey", "c_name")


@register(
    "b3_null_safe_equal",
    """
    WITH x AS (SELECT event_id, nullif(event_id % 3, 0) AS a, nullif(user_id % 3, 0) AS b FROM events)
    SELECT event_id, a IS NOT DISTINCT FROM b AS same, a = b AS equal FROM x
    """,
)
def null_safe_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("event_id") % 3, F.lit(0)).alias("a"), F.nullif(F.col("user_id") % 3, F.lit(0)).alias("b"))
    return x.select("event_id", F.col("a").eqNullSafe(F.col("b")).alias("same"), (F.col("a") == F.col("b")).alias("equal"))


register_sql(
    "b4_conditionals",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS level,
      CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status, coalesce(nullif(o_orderstatus, 'P'), 'none') AS known,
      greatest(o_totalprice, 1000.0, CAST(NULL AS DOUBLE)) AS most, least(o_totalprice, 1000.0) AS least_price
    FROM orders
    """,
)
register_sql("b5_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
register_sql("b5_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
register_sql("b5_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)")
register_sql("b5_correlated_subquery", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(m.l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)")


@register(
    "b6_not_in_with_null",
    """
    SELECT 'with null' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_totalprice > 300000)
    UNION ALL SELECT 'without' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_totalprice > 300000 AND o_custkey <> 1)
    UNION ALL SELECT 'no values' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)
    """,
)
def not_in_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null among the values leaves no row; without it those of no large order stay; without values all do."""
    orders = table(spark, sf_dir, "orders")
    large = orders.filter("o_totalprice > 300000")
    out = None
    for kind, some in (("with null", large.select(F.nullif(F.col("o_custkey"), F.lit(1)).alias("k"))), ("without", large.filter("o_custkey <> 1").select("o_custkey")), ("no values", orders.filter("o_totalprice < 0").select("o_custkey"))):
        kept = not_in(table(spark, sf_dir, "customer").select(F.lit(kind).alias("kind"), "c_custkey"), "c_custkey", some)
        out = kept if out is None else out.unionByName(kept)
    return out


@register("b6_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def not_in_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_in(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_partkey"))


register_sql(
    "b7_casts",
    "SELECT o_orderkey, CAST(o_totalprice AS INT) AS whole, CAST(o_orderkey AS STRING) AS name, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS level, try_cast(o_orderpriority AS INT) AS none, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS price FROM orders",
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS whole, CAST(o_orderkey AS VARCHAR) AS name, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS level, try_cast(o_orderpriority AS INT) AS none, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS price FROM orders",
)


@register("b8_explode", "SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def explode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    per_doc = words.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


register_sql(
    "b8_lateral_view",
    "SELECT vec_id, pos, x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x",
    "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS pos, unnest(embedding) AS x FROM embeddings",
)
register_sql(
    "b9_pivot",
    "SELECT * FROM (SELECT c_nationkey, c_mktsegment, c_acctbal FROM customer) PIVOT (round(sum(c_acctbal), 2) FOR c_mktsegment IN ('AUTOMOBILE' AS auto, 'BUILDING' AS building, 'MACHINERY' AS machinery))",
    """SELECT c_nationkey, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'AUTOMOBILE'), 2) AS auto, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 2) AS building,
       round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 2) AS machinery FROM customer GROUP BY c_nationkey""",
)


@register("b9_unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, kind, amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem WHERE l_quantity = 1) UNPIVOT (amount FOR kind IN (l_discount, l_tax))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity = 1")
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "kind", "amount")


_CHAIN = """
    WITH RECURSIVE follows AS (SELECT o_custkey, o_orderkey, o_totalprice, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM orders),
    firsts AS (SELECT min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey),
    chain(o_custkey, o_orderkey, next_key, place, most) AS (
      SELECT o_custkey, o_orderkey, next_key, 1, o_totalprice FROM follows JOIN firsts ON o_orderkey = first_key
      UNION ALL SELECT f.o_custkey, f.o_orderkey, f.next_key, c.place + 1, greatest(c.most, f.o_totalprice) FROM chain c JOIN follows f ON f.o_orderkey = c.next_key WHERE c.place < 5)
    SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place, most FROM chain
    """
# without LIMIT ALL Spark stops a recursion at a million rows by an error
register_sql("b10_recursive_cte", f"{_CHAIN} LIMIT ALL", _CHAIN)
register_sql("f1_sort", "SELECT p_partkey, p_size, nullif(p_brand, 'Brand#11') AS brand FROM part ORDER BY brand DESC NULLS LAST, p_size ASC NULLS FIRST, p_partkey")
register_sql("f2_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")


@register("f3_top_k", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TakeOrderedAndProject: each task keeps its own hundred."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


register_sql("f4_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
register_sql("f4_union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")


@register("f4_union_by_name", "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


register_sql("f5_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
register_sql("f5_intersect_all", "SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
register_sql("f5_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
register_sql("f5_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0")
register_sql("f6_distinct", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")


@register("f6_drop_duplicates", "SELECT DISTINCT event_type, user_id FROM events")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of a key stays isn't defined, so the keys are what can be told."""
    return table(spark, sf_dir, "events").dropDuplicates(["event_type", "user_id"]).select("event_type", "user_id")


@register("f6_first_of_each", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dropDuplicates() keeps any row of a key; the smallest id makes the choice defined."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@register("f7_sample")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bernoulli sampling by a seed; other engines draw other rows, so it has no SQL."""
    return table(spark, sf_dir, "lineitem").sample(fraction=0.1, seed=7).select("l_orderkey", "l_linenumber", "l_partkey")


@register("f7_table_sample")
def table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TABLESAMPLE in SQL, repeatable by its seed; other engines draw other rows, so it has no SQL."""
    views(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_custkey FROM orders TABLESAMPLE (20 PERCENT) REPEATABLE (11)")


@register("f7_exact_strata", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3:' || o_orderkey), o_orderkey) <= 100")
def exact_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred orders of each priority, the same on every run and engine."""
    return smallest_hashes(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 100, seed=3)


@register("f7_fixed_size", "SELECT event_id, user_id FROM events ORDER BY md5('5:' || event_id), event_id LIMIT 250")
def fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of 250 events."""
    return smallest_hashes(table(spark, sf_dir, "events").select("event_id", "user_id"), [], "event_id", 250, seed=5)


@register("f7_hash_sample", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS INT) < 6554")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders by their keys' hashes: the same rows on every run and engine."""
    bits = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 4), 16, 10).cast("int")
    return table(spark, sf_dir, "orders").filter(bits < 6554).select("o_orderkey", "o_custkey")
