"""Streams with state of their own: a replay log with time to live, jobs reconciled with reports about them, and sinks that a replayed batch does not change.

Each stream has a batch form for whole tables with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import query
from ..plans.session import latest, table
from ..plans.snapshots import Snapshots

#: Seconds that a log lives after its last event.
REPLAY_SECONDS = 1800
STALE_SECONDS = 300
LOG = "user_id bigint, event_id bigint, seq bigint, state string"


class ReplayLog(StatefulProcessor):
    """A key's log: its events in order, the number of the last one and its time; it ends REPLAY_SECONDS after the last event.

    The list is what a reader that comes back is served from; a timer clears it once the watermark is past its end, and tells how long it was.
    """

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("log", "event_id bigint, ts_ms bigint")
        self.last = handle.getValueState("last", "seq bigint, ts_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(t.timestamp() * 1000), e) for pdf in rows for t, e in zip(pdf["ts"], pdf["event_id"].tolist(), strict=True))
        found = self.last.get() if self.last.exists() else None
        seq, last, kept, out = (found[0], found[1], [], []) if found else (0, None, [], [])
        for now, event in new:
            if last is not None and now - last > self.seconds * 1000:
                out.append((None, seq, "expired"))
                self.events.clear()
                seq, kept = 0, []
            seq += 1
            last = now if last is None else max(last, now)
            kept.append((event, now))
            out.append((event, seq, "event"))
        self.events.appendList(kept)
        self.last.update((seq, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.seconds * 1000)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq = self.last.get()[0] if self.last.exists() else 0
        self.events.clear()
        self.last.clear()
        yield self._rows(key, [(None, seq, "expired")] if seq else [])

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        frame = pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": pd.array([r[0] for r in out], dtype="Int64"), "seq": [r[1] for r in out], "state": [r[2] for r in out]})
        return frame.astype({"user_id": "int64", "seq": "int64", "state": "object"})

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, seconds: int = REPLAY_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, seq, state): each event with its number in its key's log, and a row `expired` with the number of events of a log that has ended.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    keyed = events.withWatermark("ts", late).select("user_id", "event_id", "ts").groupBy("user_id")
    return keyed.transformWithStateInPandas(ReplayLog(seconds), LOG, "append", "EventTime")


def replay_rows(events: DataFrame, seconds: int = REPLAY_SECONDS) -> DataFrame:
    """The same for a table: a log ends where the next event of its key is more than seconds away (or missing)."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(own).cast("timestamp"))) > seconds * 1000
    logs = events.filter("ts IS NOT NULL").withColumn("log", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(own))
    numbered = logs.withColumn("seq", F.row_number().over(Window.partitionBy("user_id", "log").orderBy("ts", "event_id")).cast("long"))
    ends = logs.groupBy("user_id", "log").agg(F.count(F.lit(1)).alias("seq")).select("user_id", F.lit(None).cast("long").alias("event_id"), "seq", F.lit("expired").alias("state"))
    return numbered.select("user_id", "event_id", "seq", F.lit("event").alias("state")).unionByName(ends)


def replayed(log: DataFrame, after: Column) -> DataFrame:
    """What a reader that has seen the events up to number after gets of the logs that still live."""
    ended = log.filter("state = 'expired'").groupBy("user_id").agg(F.count(F.lit(1)).alias("ended"))
    part = log.filter("state = 'event'").withColumn("log", F.sum(F.when(F.col("seq") == 1, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("event_id"))).join(ended, "user_id", "left")
    return part.filter((F.col("log") > F.coalesce("ended", F.lit(0))) & (F.col("seq") > after)).select("user_id", "event_id", "seq")


@query(
    f"""WITH o AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > {REPLAY_SECONDS * 1000}, false)::INT AS opens FROM events WHERE ts IS NOT NULL),
  l AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS log FROM o)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, log ORDER BY ts, event_id) AS seq, 'event' AS state FROM l
UNION ALL SELECT user_id, NULL, count(*), 'expired' FROM l GROUP BY user_id, log"""
)
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event numbered in its user's log, and every log's length when it ends 30 minutes after its last event."""
    return replay_rows(table(spark, sf_dir, "events"))


def jobs_and_reports(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purchases as jobs (job, started) and all other events as reports of the same user (key, reported)."""
    jobs = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("job"), F.col("user_id").alias("owner"), F.col("ts").alias("started"))
    reports = events.filter("event_type != 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("reported"), F.col("event_id").alias("report"))
    return jobs, reports


def reconciled(jobs: DataFrame, reports: DataFrame, seconds: int = STALE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(job, owner, started, report): each job with every report of its owner within seconds of its start; a job without one has a null report.

    jobs: job, owner, started; reports: key, reported, report. For two streams each side is kept only as long as the other one can still bring a partner: watermarks
    and the bound on times let Spark drop older rows, and rows without a partner come out when the watermark is past their bound.
    """
    if jobs.isStreaming:
        jobs, reports = jobs.withWatermark("started", late), reports.withWatermark("reported", late)
    near = (F.col("owner") == F.col("key")) & (F.col("reported") >= F.col("started")) & (F.col("reported") <= F.col("started") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return jobs.join(reports, near, "left_outer").select("job", "owner", "started", "report")


def job_states(matched: DataFrame) -> DataFrame:
    """(job, n_reports, state): failed where no report has come in time."""
    return matched.groupBy("job").agg(F.count("report").alias("n_reports")).withColumn("state", F.when(F.col("n_reports") == 0, "failed").otherwise("running"))


@query(
    f"""SELECT j.event_id AS job, count(r.event_id) AS n_reports, CASE WHEN count(r.event_id) = 0 THEN 'failed' ELSE 'running' END AS state
FROM events j LEFT JOIN events r ON r.user_id = j.user_id AND r.event_type != 'purchase' AND r.ts BETWEEN j.ts AND j.ts + INTERVAL {STALE_SECONDS} SECOND WHERE j.event_type = 'purchase' GROUP BY j.event_id"""
)
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose owner shows no sign of life within five minutes count as failed."""
    return job_states(reconciled(*jobs_and_reports(table(spark, sf_dir, "events"))))


# Sinks that tolerate replays ----------------------------------------------------------------------------------------------


def progress_sink(store: Snapshots, key: str = "doc_id", order: str = "updated") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the newest status of each key (table status) and every event once (table events), both in one commit.

    The number of the last batch is stored with the commit, so a batch that Spark replays after a crash changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        since = store.version()
        manifest = store.manifest(since)
        if manifest["notes"].get("batch", -1) >= batch_id:
            return
        numbered = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        old = store.read("status", since) if "status" in manifest["tables"] else None
        status = latest(numbered if old is None else old.unionByName(numbered), key, order)
        store.commit({"status": status}, {"events": numbered}, since, {"batch": batch_id})

    return write


def index_sinks(sinks: Mapping[str, tuple[Snapshots, Callable[[DataFrame], DataFrame]]], report: Snapshots, key: str = "chunk_id", order: str = "updated") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts each batch into several stores and keeps a report of what each has taken.

    sinks: for each name its store and what it keeps of the rows. Each store remembers its own last batch, so after a crash between two stores
    only those that missed the batch write it. A store that fails or holds fewer keys than were sent is reported as degraded; the others go on, and the
    batch counts as done (its rows are sent again when they are next upserted).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sent = latest(batch, key, order)
        n, rows = sent.count(), []
        for name, (store, shaped) in sinks.items():
            try:
                since = store.version()
                manifest = store.manifest(since)
                if manifest["notes"].get("batch", -1) < batch_id:
                    new = shaped(sent)
                    old = store.read("rows", since).join(new.select(key), key, "left_anti") if "rows" in manifest["tables"] else new.limit(0)
                    store.commit({"rows": old.unionByName(new)}, None, since, {"batch": batch_id})
                there = store.read("rows").join(sent.select(key), key, "left_semi").count()
                rows.append((batch_id, name, n, there, "ok" if there >= n else "degraded", None))
            except Exception as error:
                rows.append((batch_id, name, n, 0, "degraded", str(error)[:200]))
        since = report.version()
        if report.manifest(since)["notes"].get("batch", -1) < batch_id:
            table = batch.sparkSession.createDataFrame(rows, "batch long, sink string, sent long, indexed long, state string, error string")
            report.commit(None, {"reports": table}, since, {"batch": batch_id})

    return write
