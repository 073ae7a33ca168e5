"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def exact_quantiles(df: DataFrame, by: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and, for each name of wanted, the quantile of its (column, q), interpolated between its neighbours, of each group.

    Different values of all columns are counted first, then sorted into range partitions and written, once for them all.
    A value's rank is the rows of its group and column in the partitions before, one number for each group, column and
    partition, and those before it in its own. So a group of any size is spread over partitions. Nulls don't count, and a
    column without other values gives null; a group without values in any column has no row. Null in by is a group.
    """
    columns = list(dict.fromkeys(value for value, _ in wanted.values()))
    each = F.array(*(F.struct(F.lit(k).alias("of"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)))
    values = df.select(F.col(by).alias("_by"), F.explode(each).alias("_each")).select("_by", F.col("_each.of").alias("_of"), F.col("_each.value").alias("_value"))
    counted = values.filter("_value IS NOT NULL").groupBy("_by", "_of", "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = written(counted.repartitionByRange("_by", "_of", "_value").withColumn("_part", F.spark_partition_id()), "quantile-values")
    parts = placed.groupBy("_by", "_of", "_part").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy("_by", "_of")
    parts = parts.select(
        F.col("_by").alias("_in_by"),
        F.col("_of").alias("_in_of"),
        F.col("_part").alias("_in"),
        (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_base"),
        F.sum("_n").over(group).alias("_all"),
    )
    same = F.col("_by").eqNullSafe(F.col("_in_by")) & (F.col("_of") == F.col("_in_of")) & (F.col("_part") == F.col("_in"))
    upto = F.sum("_n").over(Window.partitionBy("_by", "_of", "_part").orderBy("_value"))
    ranked = placed.join(parts, same).withColumn("_last", F.col("_base") + upto - 1)
    holds = lambda at: (at <= F.col("_last")) & (at > F.col("_last") - F.col("_n"))
    used, found, results = F.lit(False), [], [F.col("_by").alias(by)]
    for i, (name, (value, q)) in enumerate(wanted.items()):
        own, rank = F.col("_of") == columns.index(value), (F.col("_all") - 1) * F.lit(q)
        at_low, at_high = own & holds(F.floor(rank)), own & holds(F.ceil(rank))
        used = used | at_low | at_high
        found += [F.max(F.when(at_low, F.col("_value"))).alias(f"_low{i}"), F.max(F.when(at_high, F.col("_value"))).alias(f"_high{i}"), F.max(F.when(own, rank - F.floor(rank))).alias(f"_share{i}")]
        results.append((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_share{i}")).alias(name))
    return ranked.filter(used).groupBy("_by").agg(*found).select(*results)


def exact_quantile(df: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """by and the q-quantile of value, as exact_quantiles() gives it."""
    return exact_quantiles(df, by, {name: (value, q)})
