"""Event-time windows, first-request rate limits and stuck-task timeouts, as streams; each has a batch form for whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.registry import query
from ..plans.session import table

LIMIT_SECONDS, LIMIT_EVENTS = 3600, 2
GAP = "2 hours"


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream of events."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts by hour and kind, for a stream (late events up to the watermark count) or a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_hourly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(table(spark, sf_dir, "events"))


@query(
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, no"""
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a gap of two hours ends."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", GAP).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def limited(events: DataFrame, seconds: int = LIMIT_SECONDS, most: int = LIMIT_EVENTS) -> DataFrame:
    """(event_id, user_id, allowed): a window opens at a user's first event and lasts seconds; later events open the next.

    The window's start folds along a user's events, which no window function expresses. Spark sorts each user's events into one
    partition and the fold passes over Arrow batches, holding two numbers: a user of any size needs no more memory than a batch.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, start, used = object(), None, 0
        for batch in batches:
            out = []
            for who, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if who != user or start is None or t - start >= seconds * 1_000_000:
                    user, start, used = who, t, 0
                used += 1
                out.append(used <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["event_id", "user_id", "allowed"])

    rows = events.filter(F.col("ts").isNotNull()).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(fold, "event_id bigint, user_id bigint, allowed boolean")


@query(
    f"""WITH RECURSIVE starts AS (
  SELECT user_id, min(ts) AS start FROM events GROUP BY user_id
  UNION ALL SELECT s.user_id, min(e.ts) FROM starts s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.start + INTERVAL {LIMIT_SECONDS} SECOND GROUP BY s.user_id
), placed AS (SELECT e.event_id, e.user_id, e.ts, s.start FROM events e ASOF JOIN starts s ON e.user_id = s.user_id AND e.ts >= s.start)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, start ORDER BY ts, event_id) <= {LIMIT_EVENTS} AS allowed FROM placed"""
)
def rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited(table(spark, sf_dir, "events"))


def limited_stream(events: DataFrame, seconds: int = LIMIT_SECONDS, most: int = LIMIT_EVENTS) -> DataFrame:
    """The same for a stream: the state of a user is the window's start and count, dropped when the window is over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = sorted((t.timestamp(), e, u) for pdf in batches for t, e, u in zip(pdf["ts"], pdf["event_id"].tolist(), pdf["user_id"].tolist(), strict=True))
        out = []
        for now, _, _ in rows:
            if start is None or now - start >= seconds:
                start, used = now, 0
            used += 1
            out.append(used <= most)
        state.update((start, used))
        state.setTimeoutTimestamp(max(int((start + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": [r[1] for r in rows], "user_id": [r[2] for r in rows], "allowed": out})

    keyed = events.withWatermark("ts", "10 minutes").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "event_id bigint, user_id bigint, allowed boolean", "start double, used bigint", "append", GroupStateTimeout.EventTimeTimeout)


@query("SELECT user_id, max(ts) AS last_ts, CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR THEN 'failed' ELSE 'running' END AS state FROM events GROUP BY user_id")
def stuck_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without an event in the last day before the newest event count as failed."""
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").alias("now"))
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last_ts")).crossJoin(F.broadcast(now))
    return last.select("user_id", "last_ts", F.when(F.col("last_ts") < F.col("now") - F.expr("INTERVAL 24 HOURS"), "failed").otherwise("running").alias("state"))


@query("SELECT event_id, user_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 3")
def replay_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the third of each key, numbered."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("seq", seq).filter("seq > 3").select("event_id", "user_id", "seq")
