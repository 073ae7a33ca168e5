"""Joins of the engine's own against naive ones, on constructed and generated rows."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataframe.functions.vectors import cosine_similarity, dot, l2_distance
from strataframe.operators.antijoin import not_in
from strataframe.operators.asof import asof_join
from strataframe.operators.quantiles import exact_quantile, exact_quantiles
from strataframe.operators.ranges import band_join, interval_join
from strataframe.operators.salting import salted_distinct_count, salted_join

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
number = st.one_of(st.none(), st.integers(0, 12))
pairs = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), number), max_size=14)


@few
@given(pairs, pairs)
def test_asof_equals_naive(spark, left, right):
    right = [(k, t, n) for n, (k, t) in enumerate(right)]
    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    got = sorted(map(tuple, asof_join(a, b, ["k"], "t", tie="v").collect()), key=repr)
    want = []
    for k, t in left:
        found = [(s, v) for j, s, v in right if None not in (j, s, k, t) and j == k and s <= t]
        want.append((k, t, *(max(found) if found else (None, None))))
    assert got == sorted(want, key=repr)


def test_asof_tolerance_and_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 10), (1, 3)], "k int, t int"), spark.createDataFrame([(1, 2, "x")], "k int, t int, v string")
    assert sorted(map(tuple, asof_join(a, b, ["k"], "t", tolerance=F.lit(5)).collect())) == [(1, 3, 2, "x"), (1, 10, None, None)]
    assert asof_join(a.limit(0), b, ["k"], "t").count() == 0
    assert [r["right_v"] for r in asof_join(a, b.limit(0), ["k"], "t").collect()] == [None, None]


@few
@given(st.lists(number, max_size=14), st.lists(number, max_size=14), st.integers(1, 4))
def test_band_equals_naive(spark, left, right, width):
    a, b = spark.createDataFrame([(x,) for x in left], "x int"), spark.createDataFrame([(x,) for x in right], "y int")
    got = sorted(map(tuple, band_join(a, b, F.col("x"), F.col("y"), width).collect()))
    assert got == sorted((x, y) for x in left for y in right if None not in (x, y) and abs(x - y) <= width)


@few
@given(st.lists(st.integers(-5, 20), max_size=14), st.lists(st.tuples(st.integers(-5, 20), st.integers(0, 9)), max_size=10))
def test_interval_equals_naive(spark, points, spans):
    spans = [(a, a + n) for a, n in spans]
    p, s = spark.createDataFrame([(x,) for x in points], "x int"), spark.createDataFrame(spans, "a int, b int")
    got = sorted(map(tuple, interval_join(p, s, F.col("x"), F.col("a"), F.col("b"), 3).collect()))
    assert got == sorted((x, a, b) for x in points for a, b in spans if a <= x < b)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    a = spark.range(200).select((F.col("id") % 7).alias("k"), "id")
    b = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k long, v string")
    got, want = salted_join(a, b, "k", 5, F.col("id"), how), a.join(b, "k", how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_salted_join_refuses_to_repeat_rows(spark):
    with pytest.raises(ValueError):
        salted_join(spark.range(1), spark.range(1), "id", 2, F.col("id"), "full")


def test_salted_distinct_count(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3)], "k string, v int")
    assert sorted(map(tuple, salted_distinct_count(df, "k", "v", "n").collect()), key=repr) == sorted([("a", 2), ("b", 0), (None, 1)], key=repr)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(dot(F.col("a"), F.col("b")), cosine_similarity(F.col("a"), F.col("b")), l2_distance(F.col("a"), F.col("b")), cosine_similarity(F.col("a"), F.col("z"))).first()
    assert row[0] == 24.0 and abs(row[1] - 0.96) < 1e-12 and abs(row[2] - 2**0.5) < 1e-12 and row[3] is None


@few
@given(st.lists(number, max_size=8), st.lists(number, max_size=6))
def test_not_in_equals_sql(spark, left, right):
    a, b = spark.createDataFrame([(x,) for x in left], "x int"), spark.createDataFrame([(x,) for x in right], "y int")
    want = [x for x in left if not right or None not in (x, *right) and x not in right]
    assert sorted((r["x"] for r in not_in(a, "x", b).collect()), key=repr) == sorted(want, key=repr)


@few
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(-9, 9))), max_size=40), st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_exact_quantile_equals_numpy(spark, rows, q):
    groups = {k: [v for j, v in rows if j == k and v is not None] for k, _ in rows}
    got = {r["k"]: r["x"] for r in exact_quantile(spark.createDataFrame(rows, "k int, v int"), "k", "v", q, "x").collect()}
    assert got == pytest.approx({k: float(np.quantile(v, q)) for k, v in groups.items() if v})


@few
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), number, number), max_size=40))
def test_quantiles_of_several_columns_equal_numpy(spark, rows):
    wanted = {"a": ("v", 0.5), "b": ("w", 0.9), "c": ("v", 0.25), "d": ("w", 1.0)}
    got = {r["k"]: r.asDict() for r in exact_quantiles(spark.createDataFrame(rows, "k int, v int, w int"), "k", wanted).collect()}
    assert set(got) == {k for k, v, w in rows if v is not None or w is not None}
    for k, r in got.items():
        for name, (column, q) in wanted.items():
            values = [x["vw".index(column) + 1] for x in rows if x[0] == k and x["vw".index(column) + 1] is not None]
            assert r[name] == (pytest.approx(float(np.quantile(values, q))) if values else None)


@few
@given(pairs, pairs, st.integers(1, 5))
def test_asof_by_spans_equals_asof(spark, left, right, width):
    right = [(k, t, n) for n, (k, t) in enumerate(right)]
    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    whole, parts = (asof_join(a, b, ["k"], "t", tie="v", span=span) for span in (None, lambda t: F.floor(t / width)))
    assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_folders_are_deleted_but_those_kept(spark):
    from strataframe.sources.scratch import discard, made_folders, written

    before = made_folders()
    a, b = written(spark.range(3), "a"), written(spark.range(4), "b")
    discard(spark, before, b)
    assert made_folders() - before == {b.written_at} and b.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST|cannot read"):
        a.collect()
    discard(spark, before)
    assert made_folders() == before
