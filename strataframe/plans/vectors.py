"""Nearest neighbours of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearest import fit_index, nearest_exact
from ..sources.tables import table
from .registry import register

_EXACT = """
    SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS place
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY place <= 10
    """


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.filter("vec_id % 100 = 0")


def _told(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@register("g10_nearest_exact", _EXACT)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to each vector whose id is divisible by 100."""
    return _told(nearest_exact(*_asked(spark, sf_dir), "vec_id", "embedding"))


@register("g10_nearest_by_index")
def nearest_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the inverted-file index; approximate, so it has no SQL. Tests measure its recall against the exact search."""
    rows, asked = _asked(spark, sf_dir)
    return _told(fit_index(rows, "vec_id", "embedding").search(asked, "vec_id", "embedding"))


@register("g10_index_holds_every_row", "SELECT vec_id AS id, count(*) AS n FROM embeddings GROUP BY vec_id")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("g10_index_of_all_lists", _EXACT)
def all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that asks for every list gets what the exact search gets."""
    rows, asked = _asked(spark, sf_dir)
    index = fit_index(rows, "vec_id", "embedding", lists=16)
    return _told(index.search(asked, "vec_id", "embedding", probes=16))
