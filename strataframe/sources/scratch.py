"""Folders that driver and executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Each thread's own, so that queries that run side by side don't delete each other's folders.
_OWN = threading.local()
#: Bytes of the driver's heap up to which old plans may lie there.
SMALL_HEAP = 160 << 20
#: What the driver's heap held after its last collection, by SparkContext.
_HELD: dict[str, int] = {}


def _made() -> dict[str, None]:
    return _OWN.__dict__.setdefault("made", {})



def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below spark.checkpoint.dir; only a local session may do without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", at)
    made = f"{at.rstrip('/')}/strataframe/{label}-{uuid.uuid4().hex}"
    _made()[made] = None
    return made


def _collected(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage where that is more than what it held after the last time. A written table's plans,
    broadcasts and shuffles are garbage, and Spark's cleaner frees them on the executors only after that; left to
    itself the heap grows to its limit first, and doesn't shrink."""
    runtime, app = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext.applicationId
    held = lambda: runtime.totalMemory() - runtime.freeMemory()
    if held() > max(SMALL_HEAP, 2 * _HELD.get(app, 0)):
        runtime.gc()
        _HELD[app] = held()


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to a shared folder and reads it back: lineage ends there,
    and a lost executor costs only the tasks that read it."""
    at = shared_folder(df.sparkSession, label)
    df.write.parquet(at)
    _collected(df.sparkSession)
    made = df.sparkSession.read.schema(df.schema).parquet(at)
    made.written_at = at
    return made


def made_folders() -> frozenset[str]:
    """The shared folders that this thread has made and not deleted."""
    return frozenset(_made())


def discard(spark: SparkSession, before: frozenset[str] = frozenset(), *keep: DataFrame) -> None:
    """Deletes the shared folders that this thread made after before, but for those of keep (from written())."""
    kept = before | {df.written_at for df in keep}
    for at in [x for x in _made() if x not in kept]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _made()[at]
