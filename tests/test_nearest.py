"""Nearest neighbours: exact against plain numpy, the index's recall, odd rows, a vector that many rows have."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import nearest as op
from strataframe.sources.tables import table

SCHEMA = "id long, v array<float>"


def _brute(rows, asked, k):
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    out = []
    for i, v in asked:
        q = np.array(v, np.float64) / np.linalg.norm(v)
        s = np.round(x @ q, op.DIGITS)
        out += [(i, int(ids[p]), n + 1) for n, p in enumerate(np.lexsort((ids, -s))[:k])]
    return sorted(out)


def _rows(n, dim=8, seed=0):
    r = np.random.default_rng(seed)
    return [(int(i), r.normal(size=dim).round(3).tolist()) for i in r.permutation(n)]


def _got(df):
    return sorted((r["query_id"], r["id"], r["place"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 500])
def test_exact_equals_plain(spark, monkeypatch, k):
    monkeypatch.setattr(op, "BLOCK", 50)
    monkeypatch.setattr(op, "QUERIES", 4)
    rows = _rows(230)
    asked = [r for r in rows if r[0] % 20 == 0]
    got = op.nearest_exact(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), "id", "v", k)
    assert _got(got) == _brute(rows, asked, k)


def test_a_vector_that_a_third_of_the_rows_have(spark, monkeypatch):
    """Its list is several blocks; ties go to smaller ids."""
    monkeypatch.setattr(op, "BLOCK", 40)
    rows = _rows(200, seed=2) + [(1_000 + k, [1.0, 2.0, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0]) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [r for r in rows if r[0] % 50 == 0]
    index = op.fit_index(df, "id", "v", k=5, lists=6)
    assert index.rows.count() == 300
    found = index.search(spark.createDataFrame(asked, SCHEMA), "id", "v", 5, probes=6)
    assert _got(found) == _brute(rows, asked, 5)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall(spark, sf):
    rows = table(spark, f"/root/testdata/sf{sf}", "embeddings")
    asked = rows.filter("vec_id % 100 = 0")
    index = op.fit_index(rows, "vec_id", "embedding")
    exact = op.nearest_exact(rows, asked, "vec_id", "embedding")
    assert exact.count() == 10 * asked.count()
    assert op.recall(index.search(asked, "vec_id", "embedding"), exact) >= 0.9
    assert index.told >= 0.97 and index.probes < len(index.centroids)


def test_clustered_vectors_need_few_lists(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.05 * r.normal(size=16)).tolist()) for k in range(1_200)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.filter("id % 100 = 0")
    index = op.fit_index(df, "id", "v", sample=600, lists=12)
    assert index.probes <= 3
    assert op.recall(index.search(asked, "id", "v"), op.nearest_exact(df, asked, "id", "v")) >= 0.9


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [None, 1.0]), (6, [-1.0, 0.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit("x")).withColumn("part", F.lit(None).cast("int"))
    assert _got(op.nearest_exact(df, df, "id", "v", 2)) == [(1, 1, 1), (1, 4, 2), (4, 1, 1), (4, 4, 2), (6, 1, 2), (6, 6, 1)]
    index = op.fit_index(df, "id", "v")
    assert sorted(r["id"] for r in index.rows.collect()) == [1, 4, 6]
    none = df.limit(0)
    assert _got(op.nearest_exact(none, df, "id", "v")) == [] == _got(op.nearest_exact(df, none, "id", "v"))
    assert op.fit_index(none, "id", "v").search(df, "id", "v").count() == 0
