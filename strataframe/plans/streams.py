"""Streaming queries: each runs a stream over the table's files and returns what its sink holds."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder
from ..sources.tables import SCHEMAS, table
from ..streaming.events import IDLE_MS, Activity, RunningTotals, TimedSessions, idle_users, replayed, sessions, tumbling, with_event_time, written
from .registry import register

_TUMBLING = "SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{width}' AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 2))


@register("h1_tumbling_batch", _TUMBLING.format(width="1 hour"))
def tumbling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tumbling(table(spark, sf_dir, "events"), "1 hour"))


@register("h1_tumbling_stream", _TUMBLING.format(width="1 hour"))
def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode: the sink holds every window, the open ones too."""
    return _rounded(written(tumbling(replayed(spark, sf_dir), "1 hour"), "tumbling", "complete"))


@register("h2_sliding_batch", "SELECT b - INTERVAL 15 MINUTE * k AS window_start, b - INTERVAL 15 MINUTE * k + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS b FROM events), range(4) r(k) GROUP BY ALL")
def sliding_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tumbling(table(spark, sf_dir, "events"), "1 hour", slide="15 minutes"))


@register("h2_sliding_stream", "SELECT b - INTERVAL 15 MINUTE * k AS window_start, b - INTERVAL 15 MINUTE * k + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS b FROM events), range(4) r(k) GROUP BY ALL")
def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(written(tumbling(replayed(spark, sf_dir), "1 hour", slide="15 minutes"), "sliding", "complete"))


SESSIONS = """
    WITH x AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    y AS (SELECT user_id, ts, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, k
    """


@register("h3_sessions_batch", SESSIONS)
def sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "30 minutes")


@register("h3_sessions_stream", f"SELECT * FROM ({SESSIONS}) WHERE session_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: sessions that the watermark, ten minutes behind the last event, has closed."""
    return written(sessions(replayed(spark, sf_dir), "30 minutes", "10 minutes"), "sessions")


@register("h4_watermark_stream", f"SELECT * FROM ({_TUMBLING.format(width='6 hours')}) WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def watermark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: windows that the watermark has closed."""
    return _rounded(written(tumbling(replayed(spark, sf_dir), "6 hours", "10 minutes"), "watermark"))


@register("h4_late_rows_stream", f"SELECT * FROM ({_TUMBLING.format(width='6 hours')}) WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def late_rows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream is stopped, clicks come once more with another value, and it goes on: they are behind
    the watermark that it kept, so its result is that without them."""
    events, source, at = table(spark, sf_dir, "events"), shared_folder(spark, "late-source"), shared_folder(spark, "late")
    last = events.agg(F.max("ts")).scalar()
    late = events.filter((F.col("event_type") == "click") & (F.col("ts") < last - F.expr("INTERVAL 1 DAY"))).withColumn("value", F.lit(1e6))
    for rows in (events, late):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(source)
        made = written(tumbling(stream, "6 hours", "10 minutes"), "late", at=at)
    return _rounded(made)


@register("h5_dedup_stream", "SELECT event_id, user_id, event_type FROM events")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice in the stream; one of each passes."""
    stream = with_event_time(replayed(spark, sf_dir)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2))))
    once = stream.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    return written(once.select("event_id", "user_id", "event_type"), "dedup")


@contextlib.contextmanager
def _state_in_rocksdb(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """The state store that state of one's own logic needs, for the time of a query. empty_batches: whether batches
    without rows run, for timers; by processing time one would follow the other for ever."""
    names = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@register("h6_stateful_stream", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stateful_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each user in a state store of one's own logic."""
    with _state_in_rocksdb(spark):
        totals = replayed(spark, sf_dir).select("user_id", "value").groupBy("user_id").transformWithStateInPandas(RunningTotals(), "user_id long, n long, total double", "Update", "None")
        made = written(totals, "stateful", "update")
    last = made.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return _rounded(last.select("user_id", "x.n", "x.total"))


def _with_micros(events: DataFrame) -> DataFrame:
    return with_event_time(events).withColumn("micros", F.unix_micros("ts"))


def timed_sessions(events: DataFrame) -> DataFrame:
    """Sessions of half an hour of a stream of events, ten minutes late at most, by timers."""
    rows = _with_micros(events).withWatermark("ts", "10 minutes").select("user_id", "ts", "micros")
    return rows.groupBy("user_id").transformWithStateInPandas(TimedSessions(30 * 60_000), "user_id long, session_start timestamp_ntz, session_end timestamp_ntz, n long", "Append", "EventTime")


@register("h6_timer_sessions", f"SELECT * FROM ({SESSIONS}) WHERE session_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def timer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What h3_sessions_stream does, by timers of one's own: a session leaves without another event of its user."""
    with _state_in_rocksdb(spark):
        return written(timed_sessions(replayed(spark, sf_dir)), "timer-sessions")


@register(
    "h6_map_and_list_state",
    """
    SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts, any_value(last_events) AS last_events
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    JOIN (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS last_events FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3) GROUP BY user_id) USING (user_id) GROUP BY user_id
    """,
)
def map_and_list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each type in a map, the last three events in a list that is forgotten after an hour without change."""
    rows = _with_micros(replayed(spark, sf_dir)).select("user_id", "event_id", "event_type", "micros")
    with _state_in_rocksdb(spark, empty_batches=False):
        activity = rows.groupBy("user_id").transformWithStateInPandas(Activity(), "user_id long, counts string, last_events string", "Update", "ProcessingTime")
        made = written(activity, "activity", "update")
    last = made.groupBy("user_id").agg(F.max_by(F.struct("counts", "last_events"), "batch").alias("x"))
    return last.select("user_id", "x.counts", "x.last_events")


@register("h6_group_state_timeout", f"SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) + INTERVAL {IDLE_MS} MILLISECOND < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def group_state_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that have been idle for three days, told by the timeout of their state."""
    rows = _with_micros(replayed(spark, sf_dir)).withWatermark("ts", "10 minutes").select("user_id", "ts", "micros")
    idle = rows.groupBy("user_id").applyInPandasWithState(idle_users, "user_id long, n long, last timestamp_ntz", "n long, last long", "append", "EventTimeTimeout")
    return written(idle, "idle")


@register("h7_stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = replayed(spark, sf_dir).filter("event_type = 'purchase'")
    return written(stream.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"), "static-join")


def views_and_purchases(one: DataFrame, two: DataFrame, how: str) -> DataFrame:
    """Views of a stream of events with the purchases of another in the hour after them."""
    side = lambda df, kind: with_event_time(df).filter(F.col("event_type") == kind).select(F.col("user_id").alias(f"user_{kind}"), F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"at_{kind}")).withWatermark(f"at_{kind}", "10 minutes")
    soon = (F.col("user_view") == F.col("user_purchase")) & (F.col("at_purchase") >= F.col("at_view")) & (F.col("at_purchase") <= F.col("at_view") + F.expr("INTERVAL 1 HOUR"))
    return side(one, "view").join(side(two, "purchase"), soon, how).select("view_id", "purchase_id")


@register(
    "h7_stream_stream_join",
    "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'",
)
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a view; the watermarks bound both sides' state."""
    return written(views_and_purchases(replayed(spark, sf_dir), replayed(spark, sf_dir), "inner"), "stream-join")


_SOON = "v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR"
_WATERMARK = "(SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'purchase')) - INTERVAL 10 MINUTE FROM events)"


@register(
    "h7_stream_outer_join",
    f"""
    SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON {_SOON}
    WHERE p.event_id IS NOT NULL OR v.ts + INTERVAL 1 HOUR < {_WATERMARK}
    """,
)
def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the hour after them; one without any leaves when the watermark has passed its hour."""
    return written(views_and_purchases(replayed(spark, sf_dir), replayed(spark, sf_dir), "left_outer"), "outer-join")


@register("h8_memory_sink", "SELECT event_type, max(value) AS most FROM events GROUP BY event_type")
def memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on the driver, for results of few rows: one for each event type."""
    name = f"most_{uuid.uuid4().hex}"
    stream = replayed(spark, sf_dir).groupBy("event_type").agg(F.max("value").alias("most"))
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@register("h8_foreach_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(replayed(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "foreach-batch", "complete")
