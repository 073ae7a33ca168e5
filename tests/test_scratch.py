"""Folders that driver and executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.sources import scratch


def test_the_driver_collects_its_garbage_when_a_table_is_written(spark, monkeypatch):
    """Once it is more than what was held after the last time, and not before."""
    monkeypatch.setattr(scratch, "SMALL_HEAP", 0, raising=False)
    monkeypatch.setattr(scratch, "_HELD", {}, raising=False)
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    assert scratch.written(spark.range(5), "few").agg(F.sum("id")).first()[0] == 10
    assert whole() == before + 1
    monkeypatch.setattr(scratch, "SMALL_HEAP", 1 << 50)
    scratch.written(spark.range(5), "few")
    assert whole() == before + 1
    scratch.discard(spark)
