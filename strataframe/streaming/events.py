"""Structured Streaming over event tables: the same transformations for batch and stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import shared_folder
from ..sources.tables import SCHEMAS


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone; the session's zone is the events' zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def replayed(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream."""
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def tumbling(events: DataFrame, width: str, watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and event type. watermark: for streams."""
    rows = with_event_time(events)
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    made = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Each user's sessions: runs of events less than a gap apart."""
    rows = with_event_time(events)
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    made = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


class RunningTotals(StatefulProcessor):
    """Each user's number of events and sum of values so far, as of each batch that names them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n long, total double")

    def handleInputRows(self, key, rows, timerValues):
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


class TimedSessions(StatefulProcessor):
    """Each user's sessions, closed by event-time timers: a session leaves when the watermark has passed its end,
    whether or not another event of the user comes. An event a whole gap after the last one begins another session (session_window()
    would join them). State: the open sessions, as a list."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long")

    def _told(self, key, sessions: list[tuple]) -> pd.DataFrame:
        micros = lambda x: pd.to_datetime(pd.Series(x, dtype="int64"), unit="us")
        end = [last + 1000 * self.gap for _, last, _ in sessions]
        return pd.DataFrame({"user_id": [key[0]] * len(sessions), "session_start": micros([a for a, _, _ in sessions]), "session_end": micros(end), "n": [n for _, _, n in sessions]})

    def _kept(self, sessions: list[tuple]) -> None:
        """Keeps the open sessions and sets one timer, for the first that will end."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(at if isinstance(at, int) else at[0]))
        if sessions:
            self.open.put([tuple(map(int, s)) for s in sessions])
            self.handle.registerTimer(-(-min(last for _, last, _ in sessions) // 1000) + self.gap)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        micros = pd.concat([f["micros"] for f in rows]).astype("int64")
        found = [*self.open.get(), *((int(t), int(t), 1) for t in micros)]
        joined: list[tuple] = []
        for start, last, n in sorted(map(tuple, found)):
            if joined and start - joined[-1][1] < 1000 * self.gap:
                joined[-1] = (joined[-1][0], max(last, joined[-1][1]), joined[-1][2] + n)
            else:
                joined.append((start, last, n))
        self._kept(joined)
        yield self._told(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        sessions = [tuple(s) for s in self.open.get()]
        done = [s for s in sessions if s[1] + 1000 * self.gap <= 1000 * now]
        self._kept([s for s in sessions if s not in done])
        yield self._told(key, done)

    def close(self) -> None:
        pass


class Activity(StatefulProcessor):
    """Each user's number of events of each type (a map) and last events (a list of three at most that is forgotten
    after a time without change), as of each batch that names them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "event_type string", "n long")
        self.last = handle.getListState("last", "micros long, event_id long", ttlDurationMs=3_600_000)

    def handleInputRows(self, key, rows, timerValues):
        last = [tuple(x) for x in self.last.get()]
        for f in rows:
            for kind, n in f.groupby("event_type").size().items():
                before = self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0
                self.counts.updateValue((kind,), (before + int(n),))
            last += list(zip(f["micros"].tolist(), f["event_id"].tolist(), strict=True))
        last = sorted(last)[-3:]
        self.last.put(last)
        counts = sorted((k[0], v[0]) for k, v in self.counts.iterator())
        yield pd.DataFrame({"user_id": [key[0]], "counts": [",".join(f"{k}:{n}" for k, n in counts)], "last_events": [",".join(str(e) for _, e in last)]})

    def close(self) -> None:
        pass


def idle_users(key, frames, state):
    """For applyInPandasWithState: a user's number of events when no event of theirs has come for the time that the timeout is set to."""
    if state.hasTimedOut:
        n, last = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": pd.to_datetime([last], unit="us")})
        return
    n, last = state.get if state.exists else (0, 0)
    for f in frames:
        n, last = n + len(f), max(last, int(f["micros"].max()))
    state.update((n, last))
    state.setTimeoutTimestamp(max(-(-last // 1000) + IDLE_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"user_id": [], "n": [], "last": pd.to_datetime([])}).astype({"user_id": "int64", "n": "int64"})


#: A user without events for so long is idle.
IDLE_MS = 3 * 24 * 3_600_000


def written(stream: DataFrame, label: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs a stream over what there is to Parquet in the shared folder, and reads it back. at: the folder of
    an earlier run of the same query, which goes on from its state and watermark.

    append: all rows. complete: the last batch's table. update: every batch's rows, with the
    batch's number in column batch. A batch that is run again writes over its own files only.
    """
    spark = stream.sparkSession
    at = at or shared_folder(spark, label)
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{at}/data").start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/data")).start()
    else:
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/data/batch={batch}")).start()
        schema = stream.schema.add("batch", "long")
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/data")
