"""Streams with late rows and several batches."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from strataframe.sources.files import round_trip, write
from strataframe.sources.scratch import shared_folder
from strataframe.sources.tables import SCHEMAS
from strataframe.streaming.events import tumbling, written


def _stream(spark, tmp_path, batches):
    """A stream that reads one file for each list of (second, value), in that order."""
    now = time.time()
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(k, s, 1, "view", float(v)) for k, (s, v) in enumerate(rows)], "event_id long, s long, user_id long, event_type string, value double")
        df = df.select("event_id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s")).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
        df.coalesce(1).write.parquet(f"file://{tmp_path}/made{n}")
        part = next(p for p in os.listdir(tmp_path / f"made{n}") if p.endswith(".parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(tmp_path / f"made{n}" / part, tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (now + n, now + n))
    return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = [[(0, 1), (50, 1)], [(400, 1)], [(401, 1)], [(10, 100)], [(1000, 1)]]
    got = written(tumbling(_stream(spark, tmp_path, batches), "1 minute", "1 minute"), "late")
    assert sorted((r["n"], r["total"]) for r in got.collect()) == [(2, 2.0), (2, 2.0)]  # the late value of 100 isn't in the first window


def test_update_mode_keeps_each_batch(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[(0, 1)], [(1, 2)], [(2, 3)]])
    got = written(stream.groupBy("user_id").agg(F.sum("value").alias("total")), "updates", "update")
    assert sorted((r["batch"], r["total"]) for r in got.collect()) == [(0, 1.0), (1, 3.0), (2, 6.0)]


def test_formats_keep_nulls_quotes_and_newlines(spark):
    rows = [(1, 'a "b", c\nd', 1.5, None), (2, "", None, True), (3, None, -0.0, False)]
    for kind in ("parquet", "orc", "json"):
        df = spark.createDataFrame(rows, "k long, s string, x double, b boolean")
        assert sorted(map(tuple, round_trip(df, shared_folder(spark, "odd"), kind).collect())) == sorted(rows)


def test_partitioned_write_prunes(spark):
    at = shared_folder(spark, "pruned")
    write(spark.range(20).select("id", (F.col("id") % 4).alias("p")), at, "parquet", ("p",))
    df = spark.read.parquet(at).filter("p = 3")
    assert df.count() == 5
    assert len(df.inputFiles()) >= 1
