"""Streams with state of their own logic: timers, restarts, late rows; outer joins; functions over tables; samples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_streams import _stream

from strataframe.functions.udfs import Sessions
from strataframe.operators.asof import asof_join
from strataframe.operators.sampling import smallest_hashes
from strataframe.plans.streams import _state_in_rocksdb, timed_sessions, views_and_purchases
from strataframe.streaming.events import sessions, written

START = 1_704_067_200
MINUTE = 60


def _sessions_of(df):
    at = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 - START).cast("long")
    return sorted(map(tuple, df.select("user_id", at("session_start"), at("session_end"), "n").collect()))


BATCHES = {
    "one batch": [[(0, 1), (600, 1), (4000, 1), (9000, 1)], [(90_000, 1)]],
    "rows out of order join two sessions": [[(3000, 1), (0, 1)], [(1500, 1)], [(90_000, 1)]],
    "late rows are dropped": [[(0, 1), (50_000, 1)], [(100, 1)], [(90_000, 1)]],
}


@pytest.mark.parametrize("name", BATCHES)
def test_timers_close_the_sessions_that_spark_closes(spark, tmp_path, name):
    stream = _stream(spark, tmp_path, BATCHES[name])
    with _state_in_rocksdb(spark):
        got = _sessions_of(written(timed_sessions(stream), "timed"))
    assert got == _sessions_of(written(sessions(stream, "30 minutes", "10 minutes"), "sessions")) and got


def test_a_row_at_the_edge_of_the_gap_begins_anew(spark, tmp_path):
    """As the query's SQL has it; session_window() would join the two."""
    with _state_in_rocksdb(spark):
        got = written(timed_sessions(_stream(spark, tmp_path, [[(0, 1), (1800, 1), (3599, 1)], [(90_000, 1)]])), "timed")
    assert _sessions_of(got) == [(1, 0, 1800, 1), (1, 1800, 3599 + 1800, 2)]


def test_a_restart_goes_on_from_its_state(spark, tmp_path):
    """The first run leaves a session open; the second, in which only another hour's row comes, closes it."""
    at = f"file://{tmp_path}/run"
    with _state_in_rocksdb(spark):
        first = written(timed_sessions(_stream(spark, tmp_path, [[(0, 1), (900, 1)]])), "timed", at=at)
        assert _sessions_of(first) == []
        (tmp_path / "more").mkdir()
        _stream(spark, tmp_path / "more", [[(50_000, 1)]])
        (tmp_path / "more" / "in" / "0.parquet").rename(tmp_path / "in" / "later.parquet")
        again = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"file://{tmp_path}/in")
        assert _sessions_of(written(timed_sessions(again), "timed", at=at)) == [(1, 0, 900 + 1800, 2)]


def test_outer_join_tells_unmatched_views_once_their_hour_has_passed(spark, tmp_path):
    def side(folder, rows):
        df = spark.createDataFrame(rows, "event_id long, s long, event_type string")
        df = df.select("event_id", F.timestamp_seconds(F.lit(START) + F.col("s")).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{folder}")
        return spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/{folder}")

    views = side("views", [(1, 0, "view"), (2, 100, "view"), (3, 40_000, "view"), (4, 50_000, "view")])
    purchases = side("purchases", [(11, 99, "purchase"), (12, 45_000, "purchase"), (13, 50_100, "purchase")])
    got = sorted(map(tuple, written(views_and_purchases(views, purchases, "left_outer"), "outer").collect()), key=repr)
    # 2 has had its hour without a purchase, 3's (until 43,600) is over too; 4 meets one
    assert got == sorted([(1, 11), (2, None), (3, None), (4, 13)], key=repr)


def test_functions_over_tables(spark):
    spark.udtf.register("sessions_of", Sessions)
    rows = [(1, 0), (1, 1799), (1, 3599), (2, 5), (None, 7), (1, None)]
    df = spark.createDataFrame(rows, "who int, s int").select("who", F.timestamp_seconds(F.lit(START) + F.col("s")).alias("moment"))
    df.createOrReplaceTempView("some_rows")
    call = "SELECT * FROM sessions_of(rows => TABLE(some_rows) PARTITION BY who ORDER BY moment, key => '{key}', at => 'moment', minutes => 30)"
    got = spark.sql(call.format(key="who"))
    assert got.schema.simpleString() == "struct<who:int,session_start:timestamp,session_end:timestamp,n:bigint>"
    told = got.select("who", (F.unix_micros("session_start") / 1e6 - START).cast("long"), (F.unix_micros("session_end") / 1e6 - START).cast("long"), "n")
    assert sorted(map(tuple, told.collect()), key=repr) == sorted([(1, 0, 1799 + 1800, 2), (1, 3599, 3599 + 1800, 1), (2, 5, 1805, 1), (None, 7, 1807, 1)], key=repr)
    with pytest.raises(Exception, match="no column nobody"):
        spark.sql(call.format(key="nobody")).collect()


def test_samples_of_a_fixed_size(spark):
    df = spark.range(4_000).select("id", F.when(F.col("id") % 4 > 0, "most").when(F.col("id") % 400 == 0, None).otherwise("few").alias("s"))
    got = smallest_hashes(df, ["s"], "id", 50, seed=1)
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {"most": 50, "few": 50, None: 10}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, smallest_hashes(df.repartition(7), ["s"], "id", 50, seed=1).collect()), key=repr)
    assert smallest_hashes(df, [], "id", 50, seed=1).count() == 50 and smallest_hashes(df, [], "id", 9_999, seed=1).count() == 4_000
    mean = smallest_hashes(df, [], "id", 1_000, seed=2).agg(F.avg("id")).first()[0]
    assert abs(mean - 2_000) < 150  # four deviations


def test_rows_with_null_keys_take_no_part_in_the_as_of_window(spark):
    left = spark.createDataFrame([(None, 5), (1, None), (1, 5), (None, None)], "k int, t int")
    right = spark.createDataFrame([(None, 1, "a"), (1, 1, "b"), (1, None, "c")], "k int, t int, v string")
    for span in (None, lambda t: F.floor(t / 3)):
        got = asof_join(left, right, ["k"], "t", span=span)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 5, None, None), (1, None, None, None), (1, 5, 1, "b"), (None, None, None, None)], key=repr)
