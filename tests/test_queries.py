"""Every query of the engine against its SQL; those without SQL by what must hold of them."""

from __future__ import annotations

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from strataframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], SQL[name])


def test_those_without_sql_are_known():
    assert sorted(set(QUERIES) - set(SQL)) == ["d9_sketches", "f7_sample", "f7_table_sample", "g10_nearest_by_index"]


def test_sample_is_repeatable_and_near_its_share(spark, sf_dir):
    a, b = (sorted(map(tuple, QUERIES["f7_sample"](spark, sf_dir).collect())) for _ in range(2))
    assert a == b
    assert 400 < len(a) < 800


def test_table_sample_is_repeatable_and_near_its_share(spark, sf_dir):
    a, b = (sorted(map(tuple, QUERIES["f7_table_sample"](spark, sf_dir).collect())) for _ in range(2))
    assert a == b and 200 < len(a) < 400


def test_exact_strata_have_their_size(spark, sf_dir):
    got = QUERIES["f7_exact_strata"](spark, sf_dir).groupBy("o_orderpriority").count().collect()
    assert len(got) == 5 and {r["count"] for r in got} == {100}


def test_a_recursion_isnt_stopped_by_its_rows(spark, sf_dir):
    """Spark's limit of a million rows, lowered here, is for recursions without LIMIT ALL."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        assert_same(spark, sf_dir, QUERIES["b10_recursive_cte"], SQL["b10_recursive_cte"])
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_a_self_join_gives_every_pair_by_many_tasks(spark, tmp_path):
    suppliers = spark.range(400).selectExpr("id AS s_suppkey", "'s' AS s_name", "IF(id = 0, NULL, 7) AS s_nationkey", "id / 100D AS s_acctbal")
    suppliers.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["c10_self_join"](spark, str(tmp_path))
    by_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 399 * 398 // 2 and max(by_task) < sum(by_task) / 8
    assert_same(spark, str(tmp_path), QUERIES["c10_self_join"], SQL["c10_self_join"])


def test_keys_wider_than_their_padding(spark, tmp_path):
    """The SQL's lpad cuts what is longer than five digits."""
    keys = spark.createDataFrame([(7,), (99999,), (100000,), (1234567,), (None,)], "c_custkey long")
    keys.selectExpr("c_custkey", "'Customer#01' AS c_name", "1 AS c_nationkey", "1D AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    assert_same(spark, str(tmp_path), QUERIES["g1_more_strings"], SQL["g1_more_strings"])


def test_array_elements_are_scaled_as_floats(spark, tmp_path):
    """Each n / 100 as a float, some of which lie below n / 100: only a product in doubles is below n."""
    numbers = spark.range(4).selectExpr("id AS vec_id", "transform(sequence(-100, 100), n -> CAST((n + id * 201) / 100D AS FLOAT)) AS embedding", "CAST(id AS INT) AS label")
    numbers.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_same(spark, str(tmp_path), QUERIES["g6_more_arrays"], SQL["g6_more_arrays"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
