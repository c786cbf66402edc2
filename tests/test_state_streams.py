"""Streams with state: each equals its batch form, also over a restart; sinks are not changed by a replayed batch."""

import datetime
import time

import pytest
from inkwell.plans.snapshots import Conflict, Snapshots
from inkwell.streaming import events, state
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, user_id bigint, ts timestamp, event_type string"
FAR = (10**6, 10**6, datetime.datetime(2040, 1, 1), "view")


def in_steps(spark, small, folder, steps=3, last=True):
    """The events of some users in time order, a file for each step, and at the end one of far in the future that moves the watermark."""
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/events.parquet").filter("user_id < 12").select("event_id", "user_id", F.col("ts").cast("timestamp"), "event_type").orderBy("ts", "event_id").collect()]
    size = -(-len(rows) // steps)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + ([[FAR]] if last else [])
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.createDataFrame([r for p in parts for r in p], SCHEMA)


def run(stream, tmp_path, name="out"):
    q = stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return stream.sparkSession.read.parquet(str(tmp_path / name))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replay_log_equals_batch_and_expires(spark, small, tmp_path, rocks):
    table = in_steps(spark, small, str(tmp_path / "in"))
    day = 86_400 * 4
    out = run(state.replay_stream(events.event_stream(spark, str(tmp_path / "in"), 1), day), tmp_path)
    # The log of the last event is still alive.
    want = [r for r in rows_of(state.replay_rows(table, day)) if not (r[0] == FAR[1] and r[3] == "expired")]
    got = rows_of(out)
    assert got == want and len({r[0] for r in got if r[3] == "expired"}) > 5 and max(r[2] for r in got) > 2


def test_replay_serves_what_a_reader_has_not_seen(spark):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, 1, at(0), "a"), (2, 1, at(5), "a"), (3, 1, at(50), "a"), (4, 1, at(60), "a"), (5, 1, at(61), "a")], SCHEMA)
    log = state.replay_rows(rows).filter("NOT (state = 'expired' AND seq = 3)")
    assert rows_of(state.replayed(log, F.lit(1))) == [(1, 4, 2), (1, 5, 3)]
    assert rows_of(state.replayed(state.replay_rows(rows), F.lit(0))) == []


def test_reconciled_streams_equal_batch(spark, small, tmp_path):
    table = in_steps(spark, small, str(tmp_path / "in"), last=False)
    # A late job and a late report push both watermarks on.
    for part in ([(10**6, 10**6, FAR[2], "purchase"), (10**6 + 1, 10**6 + 1, FAR[2], "view")], [(10**6 + 2, 10**6, FAR[2], "view")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    side = lambda i: state.jobs_and_reports(events.event_stream(spark, str(tmp_path / "in"), 1))[i]
    week = 86_400 * 7
    got = [r for r in rows_of(run(state.reconciled(side(0), side(1), week), tmp_path)) if r[0] < 10**6]
    want = rows_of(state.reconciled(*state.jobs_and_reports(table), week))
    assert got == want and any(r[3] is None for r in want) and any(r[3] is not None for r in want)


def status_files(spark, folder):
    t = datetime.datetime(2024, 1, 1)
    for i, part in enumerate(([(1, 10, "parsing"), (2, 5, "queued")], [(1, 60, "indexing"), (3, 0, "queued")], [(2, 100, "ready"), (1, 100, "ready"), (1, 90, "indexing")])):
        rows = [(d, p, s, t + datetime.timedelta(minutes=10 * i + p / 100)) for d, p, s in part]
        spark.createDataFrame(rows, "doc_id bigint, percentage int, status string, updated timestamp").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)


def progress(spark, tmp_path, sink):
    schema = "doc_id bigint, percentage int, status string, updated timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()


def test_progress_sink_is_not_changed_by_a_replayed_batch(spark, tmp_path):
    status_files(spark, str(tmp_path / "in"))
    store = Snapshots(spark, str(tmp_path / "store"))
    own = state.progress_sink(store)

    def dies_after_the_commit(batch, batch_id):
        own(batch, batch_id)
        if batch_id == 1 and store.manifest()["notes"].get("died") is None:
            store.commit(notes={"died": True})
            raise RuntimeError("killed")

    first = progress(spark, tmp_path, dies_after_the_commit)
    with pytest.raises(Exception, match="killed"):
        first.awaitTermination(100)
    progress(spark, tmp_path, dies_after_the_commit).awaitTermination(100)
    assert [r[:3] for r in rows_of(store.read("status").select("doc_id", "percentage", "status"))] == [(1, 100, "ready"), (2, 100, "ready"), (3, 0, "queued")]
    assert store.read("events").count() == 7 and store.read("events").select("batch").distinct().count() == 3


def test_index_sinks_go_on_where_a_crash_has_stopped_them(spark, tmp_path):
    stores = {n: Snapshots(spark, str(tmp_path / n)) for n in ("keyword", "vector", "graph")}
    report, runs = Snapshots(spark, str(tmp_path / "report")), []
    half = lambda df: df.filter("chunk_id % 2 = 0")
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i} of {len(ids)}", datetime.datetime(2024, 1, len(ids))) for i in ids], "chunk_id bigint, text string, updated timestamp")

    def dies(df):
        runs.append("vector")
        if len(runs) == 1:
            raise KeyboardInterrupt
        return df

    sinks = {"keyword": (stores["keyword"], lambda df: df), "vector": (stores["vector"], dies), "graph": (stores["graph"], half)}
    write = state.index_sinks(sinks, report)
    with pytest.raises(KeyboardInterrupt):
        write(rows(1, 2, 3), 0)
    assert stores["keyword"].version() == 1 and stores["vector"].version() == 0 and report.version() == 0
    for _ in range(2):  # a replay, and one more
        write(rows(1, 2, 3), 0)
    assert [s.version() for s in stores.values()] == [1, 1, 1] and report.version() == 1
    write(rows(2, 4), 1)
    assert [r[0] for r in rows_of(stores["keyword"].read("rows"))] == [1, 2, 3, 4]
    assert {r[1] for r in rows_of(stores["vector"].read("rows").filter("chunk_id = 2"))} == {"text 2 of 2"}
    assert rows_of(report.read("reports").select("batch", "sink", "sent", "indexed", "state")) == [
        (0, "graph", 3, 1, "degraded"), (0, "keyword", 3, 3, "ok"), (0, "vector", 3, 3, "ok"), (1, "graph", 2, 2, "ok"), (1, "keyword", 2, 2, "ok"), (1, "vector", 2, 2, "ok"),
    ]


def test_a_failing_sink_is_reported_and_others_go_on(spark, tmp_path):
    stores = {n: Snapshots(spark, str(tmp_path / n)) for n in ("bad", "good")}
    report = Snapshots(spark, str(tmp_path / "report"))
    batch = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))], "chunk_id bigint, updated timestamp")

    def fails(df):
        raise ValueError("no connection")

    state.index_sinks({"bad": (stores["bad"], fails), "good": (stores["good"], lambda df: df)}, report)(batch, 0)
    assert rows_of(report.read("reports").select("sink", "state", "error")) == [("bad", "degraded", "no connection"), ("good", "ok", None)]


def test_latest_does_not_depend_on_order(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d")]
    out = [rows_of(state.latest(spark.createDataFrame(r, "k int, v int, s string").withColumn("a.b", F.lit(1)), "k", "v")) for r in (rows, rows[::-1])]
    assert out[0] == out[1] and len(out[0]) == 2


def test_snapshots_change_tables_together(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.names() == []
    one = spark.range(3).toDF("x")
    assert store.commit({"a": one, "b": one}, notes={"n": 1}) == 1
    assert store.commit({"a": one.limit(1)}, {"b": one}) == 2
    assert (store.read("a").count(), store.read("b").count(), store.read("a", 1).count(), store.manifest()["notes"]) == (1, 6, 3, {"n": 1})
    with pytest.raises(Conflict):
        store.commit({"a": one}, since=1)
    assert store.version() == 2 and store.read("a").count() == 1
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division by zero"):
        store.commit({"a": one, "b": one.select((F.lit(1) / F.col("x")).alias("x"))})
    assert store.version() == 2 and store.read("a").count() == 1
    store.clean()
    assert store.versions() == [2] and store.read("b").count() == 6
