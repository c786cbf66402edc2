"""Readers, writers and streams."""

from inkwell.sources import files, html
from inkwell.streaming import events
from pyspark.sql import functions as F


def test_html_lines_and_blocks(spark):
    page = "<html><head><title>t</title><style>x{}</style></head><body><header>Top of page menu</header><nav>Menu entry one</nav><article><h1>Head <b>line</b></h1><p>First paragraph of text.</p><p>short</p><p>First paragraph of text.</p><script>var a='</p>';</script><p>打印本页 print this page</p></article><footer>Footer text here</footer></body></html>"
    pages = spark.createDataFrame([(1, page), (2, "<p>Only a body line here</p>"), (3, ""), (4, None)], "page_id bigint, html string")
    got = {r["page_id"]: r["kept"] for r in html.html_lines(pages).select("page_id", html.kept_lines(F.col("lines")).alias("kept")).collect()}
    assert got == {1: ["Head line", "First paragraph of text."], 2: ["Only a body line here"], 3: [], 4: []}
    assert pages.select(html.title_of(F.col("html")).alias("t")).first()["t"] == "Head line"


def test_raw_files_and_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.csv").write_bytes("policy,owner\n报销,财务部\n差旅,\n".encode("gb18030"))
    (tmp_path / "n.HTML").write_text("<p>x</p>")
    raw = files.raw_files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[-1]: r["parser"] for r in raw.collect()} == {"t.csv": "table", "n.HTML": "html"}
    assert "财务部" in {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.decoded(raw).collect()}["t.csv"]
    fields = files.csv_fields(files.decoded(raw.filter("parser = 'table'")), "policy string, owner string")
    assert [(r["policy"], r["owner"]) for r in fields.orderBy("line_no").collect()] == [("报销", "财务部"), ("差旅", None)]
    (tmp_path / "u.csv").write_text("policy,owner\n报销,财务部\n差旅,\n", encoding="utf-8")
    rows = files.csv_rows(spark, str(tmp_path / "u.csv"))
    table = files.markdown_table(rows, F.col("policy")).first()
    assert table["n_rows"] == 2 and table["markdown"].split("\n")[:2] == ["| policy | owner |", "| --- | --- |"]


def test_json_lines_and_manifest(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "m.json").write_text('[{"filename": "f", "bytes": 3}, {"filename": "g", "error": "x"}]')
    listed = files.manifest(spark, str(tmp_path / "m.json"))
    assert [r["filename"] for r in files.not_yet_fetched(listed, listed.filter("error IS NULL")).collect()] == ["g"]


def test_writers(spark, tmp_path):
    now, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int"), spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, n int")
    values = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert values(files.replaced(now, new, "k")) == values(files.upserted(now, new, "k", "n")) == [(1, "a"), (2, "c"), (3, "d")]
    assert values(files.without(now, new, "k")) == [(1, "a")]
    files.overwrite_partitions(now, str(tmp_path / "p"), "k")
    files.overwrite_partitions(new, str(tmp_path / "p"), "k")
    assert values(spark.read.parquet(str(tmp_path / "p"))) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.sync_report(now.union(new), now, "k").first()["state"] == "degraded"
    kept = files.write_bundle(now.withColumn("outcome", F.when(F.col("k") == 1, "kept").otherwise("short")), str(tmp_path / "b"))
    assert {r["outcome"]: r["n"] for r in kept.collect()} == {"kept": 1, "short": 1}


def spread(spark, small, tmp_path):
    """The events in time order in three files, oldest first."""
    rows = spark.read.parquet(f"{small}/events.parquet")
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), rows


def run(stream, tmp_path, mode):
    q = stream.writeStream.format("parquet" if mode == "append" else "memory").queryName("out").outputMode(mode).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_hourly_stream_equals_batch(spark, small, tmp_path):
    path, rows = spread(spark, small, tmp_path)
    run(events.hourly(events.event_stream(spark, path, 100), "40 days"), tmp_path, "complete")
    got = {tuple(r) for r in spark.table("out").collect()}
    assert got == {tuple(r) for r in events.hourly(rows).collect()}


def test_rate_limit_stream_equals_batch(spark, small, tmp_path):
    path, rows = spread(spark, small, tmp_path)
    run(events.limited_stream(events.event_stream(spark, path, 100), 86400, 1), tmp_path, "append")
    got = {(r["event_id"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["event_id"], r["allowed"]) for r in events.limited(rows, 86400, 1).collect()}
    assert got == want and {a for _, a in want} == {True, False}


def test_history_as_csv(spark, tmp_path):
    rows = [('{"run_id": "a", "samples": 3, "recall": 0.5, "passed": true, "other": 1}',), ("{}",)]
    files.write_history(spark.createDataFrame(rows, "record string").coalesce(1), str(tmp_path / "h"))
    back = spark.read.option("header", True).csv(str(tmp_path / "h"))
    assert len(back.columns) == 10 and [(r["run_id"], r["samples"], r["recall"], r["passed"], r["mode"]) for r in back.orderBy(F.desc_nulls_last("run_id")).collect()] == [("a", "3", "0.5", "true", None), (None,) * 5]
