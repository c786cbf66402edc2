"""Writes over several tables of a library, decoding by score, spaces, and pages with open elements."""

import datetime

import pytest
from inkwell.functions import text as tx
from inkwell.operators import knowledge, rules, search
from inkwell.plans.snapshots import Snapshots
from inkwell.sources import documents, files, html
from pyspark.sql import functions as F

NOON = datetime.datetime(2024, 1, 1, 12)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "library"))
    docs = spark.createDataFrame([(1, "t1", "ann"), (2, "t1", "bob"), (3, "t2", "ann")], "doc_id long, tenant_id string, uploader string")
    of = lambda name: spark.createDataFrame([(d, f"{name}{i}") for d in (1, 2, 3) for i in range(2)], "doc_id long, v string")
    store.commit({"documents": docs, "keyword": of("k"), "vectors": of("v"), "edges": of("e")})
    chunks = [(d, i, f"text {d} {i}", "hr") for d in (1, 2, 3) for i in (4, 9)]
    documents.replace_chunks(store, spark.createDataFrame(chunks, "doc_id long, chunk_index int, content string, department string"))
    answers = [("u", " What  IS it ", "It is​.", [1, 2], False, NOON), ("u", "other", "Yes", [3], False, NOON), (None, "degraded", "x", [1], True, NOON), ("u", "no source", "x", [], None, NOON)]
    documents.cache_answers(store, spark.createDataFrame(answers, "user_id string, question string, answer string, citations array<long>, degraded boolean, at timestamp"))
    return store


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "doc_id long")


def test_chunks_are_replaced_by_document_and_numbered_anew(spark, store):
    new = spark.createDataFrame([(2, 7, "b", "it", 3), (2, 5, "a", "it", 1)], "doc_id long, chunk_index int, content string, department string, access_level int")
    documents.replace_chunks(store, new)
    assert rows_of(store.read("chunks")) == [
        (1, 0, "text 1 4", '{"department":"hr"}'), (1, 1, "text 1 9", '{"department":"hr"}'), (2, 0, "a", '{"access_level":1,"department":"it"}'), (2, 1, "b", '{"access_level":3,"department":"it"}'),
        (3, 0, "text 3 4", '{"department":"hr"}'), (3, 1, "text 3 9", '{"department":"hr"}'),
    ]


def test_deletes_cascade_and_only_reach_what_the_user_may_delete(spark, store):
    assert rows_of(documents.delete_documents(store, ids(spark, 1, 2, 3), "t1", "ann")) == [(1,)]
    for name in ("documents", "chunks", "keyword", "vectors", "edges"):
        assert {r["doc_id"] for r in store.read(name).collect()} == {2, 3}, name
    assert [r["question"] for r in store.read("cache").collect()] == ["other"] and rows_of(store.read("cited").select("doc_id")) == [(3,)]
    assert rows_of(documents.delete_documents(store, ids(spark, 2, 3), "t1", "root", "ADMIN")) == [(2,)]
    assert {r["doc_id"] for r in store.read("vectors").collect()} == {3}
    before = store.version() - 1
    assert {r["doc_id"] for r in store.read("documents", before).collect()} == {2, 3}


def test_cached_answers_live_for_their_time_and_go_with_what_they_cite(spark, store):
    ask = lambda *rows: rows_of(documents.cached(store, spark.createDataFrame(list(rows), "user_id string, question string, at timestamp")).select("question", "answer"))
    soon, late = NOON + datetime.timedelta(seconds=299), NOON + datetime.timedelta(seconds=300)
    assert ask(("u", "what is  IT", soon), ("v", "what is it", soon), ("u", "other", late), ("u", "degraded", soon)) == [("degraded", None), ("other", None), ("what is  IT", "It is."), ("what is it", None)]
    again = spark.createDataFrame([("u", "other", "No", [2], False, soon), ("u", "OTHER", "Maybe", [1], False, NOON)], "user_id string, question string, answer string, citations array<long>, degraded boolean, at timestamp")
    documents.cache_answers(store, again)
    assert ask(("u", "other", late)) == [("other", "No")]
    documents.invalidate(store, ids(spark, 1))
    assert ask(("u", "what is it", soon), ("u", "other", soon)) == [("other", "No"), ("what is it", None)]
    documents.sweep(store, "2024-01-01 12:30:00")
    assert store.read("cache").count() == store.read("cited").count() == 0


def test_decoding_by_score(spark, tmp_path):
    samples = {"a": "报销,财务部".encode("gb18030"), "b": "plain é".encode(), "c": b"\xef\xbb\xbfwith mark", "d": b"\xff\xff\xff broken"}
    for name, raw in samples.items():
        (tmp_path / name).write_bytes(raw)
    raw = files.raw_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.decoded(raw).collect()}
    assert got["a"] == "报销,财务部" and got["b"] == "plain é" and got["c"] == "with mark" and "�" in got["d"]
    assert {r["path"][-1]: r["text"] for r in files.decoded(raw, lossy=False).collect()}["d"] is None
    texts = ["报销 Ã ok", "锟斤拷", "µÄ ​", "", "a\n\tb"]
    scores = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.mojibake_score(F.col("t")).alias("s"), "t").collect()
    assert [r["s"] for r in scores] == [files._score(t) for t in texts]


def test_spaces(spark):
    rows = spark.createDataFrame([("　a&nbsp;&amp; \t b \n\n  c&#33; ",), (None,), ("",)], "t string").select(tx.normal_spaces(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["a & b\nc!", None, ""]


def test_open_elements_do_not_swallow_a_page(spark):
    pages = [
        (1, "<body><div><nav>menu menu menu</div><p>kept text one</p><header>top of the page<article><p>kept text two</p></article></body>"),
        (2, "<body><form><input name=x><p>field of a form</p></form><p>after the form</p><br></body>"),
        (3, "<main>one two three<br>four five six</main><footer>foot"),
    ]
    got = {r["page_id"]: r["lines"] for r in html.html_lines(spark.createDataFrame(pages, "page_id bigint, html string")).collect()}
    assert got == {1: ["kept text two"], 2: ["after the form"], 3: ["one two three", "four five six"]}


def test_rankings_side_by_side(spark):
    schema = "item_id long, doc_id long, rank int"
    out = search.compared(spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], schema), spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema))
    assert rows_of(out) == [(1, 10, 1, None, None, "lost"), (1, 11, 2, 1, 1, "kept"), (1, 12, None, 2, None, "new"), (2, 10, 1, None, None, "lost")]


def test_questions_that_name_a_title_take_table_rows_first(spark):
    hits = lambda *rows: spark.createDataFrame(list(rows), "item_id long, doc_id long, rank int")
    asked = spark.createDataFrame([(1, "《预算》 says what"), (2, "plain"), (3, "plain too")], "item_id long, phrase string")
    live, rows = hits((1, 10, 1), (1, 11, 2), (2, 20, 1)), hits((1, 12, 1), (1, 11, 2), (2, 21, 1), (3, 30, 1))
    assert rows_of(rules.keyword_path(live, rows, asked, 3)) == [(1, 10, 3), (1, 11, 2), (1, 12, 1), (2, 20, 1), (3, 30, 1)]


def test_score_of_chunks_without_a_vector_index(spark):
    rows = [(0.5, 0.25, True, "fees and terms", ["fees"], "Budget", "《Budget》?"), (None, None, None, None, None, None, None), (-0.2, 0.0, False, "", ["x"], "Budget", "budget?"), (0.1, 0.0, False, "other", ["fees"], "Plan", "《Budget》")]
    df = spark.createDataFrame(rows, "d double, s double, p boolean, sec string, ts array<string>, t string, q string")
    out = df.select(rules.fallback_score(*[F.col(c) for c in df.columns]).alias("score")).collect()
    assert [r["score"] for r in out] == [1.8, 0.0, -0.2, 0.1]


def test_a_date_alone_is_versioning(spark):
    texts = [("on 2024-1-5",), ("no date",), ("12345 of them",)]
    kinds = spark.createDataFrame(texts, "t string").select(knowledge.evidence(F.col("t")).alias("k"), F.lit("2").rlike(knowledge.DATE)).collect()
    assert [r["k"] for r in kinds][1:] == ["general", "numeric"]


def test_equal_versions_do_not_depend_on_order(spark):
    now, new = [(1, "a", 5)], [(1, "b", 5)]
    table = lambda rows: spark.createDataFrame(rows, "k int, v string, n int")
    assert rows_of(files.upserted(table(now), table(new), "k", "n")) == rows_of(files.upserted(table(new), table(now), "k", "n"))
