"""Steps that must not grow faster than their input: the same results as plain Python, without rows for pairs that meet."""

import itertools
import pathlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from inkwell import catalog
from inkwell.functions.text import keywords, runs, sentences
from inkwell.operators import cells, chunking, documents, governance, knowledge, parts, postings, scores, search
from inkwell.operators.documents import near_pairs
from pyspark.sql import functions as F

from tests import test_indexes
from tests.compare import connect, difference


def test_near_pairs_once_each_without_remembering_them(spark):
    rng = random.Random(5)
    hashes = {rng.getrandbits(64) for _ in range(5)}
    for h in list(hashes):
        for _ in range(40):
            for bit in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
                h ^= 1 << bit
            hashes.add(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    found = near_pairs(spark.createDataFrame([(h,) for h in signed], "h bigint"))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((min(a, b), max(a, b), d) for a, b in itertools.combinations(signed, 2) if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 3)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


@pytest.mark.parametrize("short, square", [(32, 1_024), (4, 5), (1, 1_024)])
def test_near_hashes_are_compared_in_runs_without_a_join(spark, monkeypatch, short, square):
    """Runs of equal blocks short and long, in one square and in many; a crowd that shares four blocks; counts without a row for a pair."""
    monkeypatch.setattr(documents, "SHORT_RUN", short, raising=False)
    monkeypatch.setattr(documents, "SQUARE", square, raising=False)
    rng = random.Random(11)
    crowd = rng.getrandbits(64)
    hashes = {crowd ^ rng.getrandbits(20) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)} | {0, 1, 7, 15, 2**64 - 1, 2**63}
    hashes |= {h ^ (1 << rng.randrange(64)) for h in list(hashes)}
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    want = sorted((min(a, b), max(a, b), d) for a, b in itertools.combinations(signed, 2) if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 3)
    rows = spark.createDataFrame([(h,) for h in [*signed, None]], "h bigint")
    found = near_pairs(rows)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 200
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    counts = documents.near_counts(rows)
    links = Counter(h for a, b, _ in want for h in (a, b))
    assert {r["h"]: r["n"] for r in counts.collect()} == links
    above = counts._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Aggregate" in above and "Join" not in above and "Generate" not in above


def test_two_hop_in_parts(spark):
    """Ends and entities in several parts and blocks, entities that lead back to themselves, middles of nearly all ends, nulls."""
    rng = random.Random(6)
    steps = {(f"n{rng.randrange(60)}", f"n{min(int(rng.expovariate(0.1)), 59)}") for _ in range(500)} | {("hub", f"n{i}") for i in range(60)} | {("n1", "hub"), ("end", "nowhere"), (None, "n1"), ("n1", None)}
    to = {}
    for a, b in steps:
        to.setdefault(a, set()).add(b)
    want = {a: len({c for b in bs if b is not None for c in to.get(b, ()) if c is not None and c != a}) for a, bs in to.items() if a is not None}
    want = {a: n for a, n in want.items() if n}
    for side in (40, 100_000):
        found = knowledge.two_hop(spark.createDataFrame(list(steps), "source string, target string"), side)
        assert {r["entity"]: r["reach"] for r in found.collect()} == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "kw_topk_permitted", "hybrid_search", "vec_lexical_blend"])
def test_search_in_parts(spark, small, monkeypatch, name):
    """Several parts and blocks give what the SQL gives, and no join makes a row for a query and a posting that meet."""
    monkeypatch.setattr(postings, "WHOLE_ROWS", -1)
    for size, n in (("PART_ROWS", 20_000), ("PART_DOCS", 70), ("BLOCK_ROWS", 60)):
        monkeypatch.setattr(parts, size, n)
    made = []
    whole = parts.top
    monkeypatch.setattr(parts, "top", lambda p, d, a, k, sizes, *more: made.append(sizes) or whole(p, d, a, k, sizes, *more))
    assert difference(spark, connect(small), catalog.queries()[name], catalog.oracle_sql()[name], small) == ""
    assert made and min(made[0]) > 1


def test_sample_of_vectors_is_bounded_for_all_tasks_together(spark):
    rows = spark.range(20_000)
    order = (F.xxhash64("id"), "id")
    low = cells.lowest(rows, 20_000, 1_000)
    assert low.count() < 1_500
    assert low.orderBy(*order).limit(1_000).collect() == rows.orderBy(*order).limit(1_000).collect()
    assert cells.lowest(rows, 20_000, 15_000).count() == 20_000


def test_injection_filter_cleans_each_text_once_for_all_phrases(spark, small):
    plan = governance.injection_filter(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2 < len(governance.INJECTIONS)


def test_cut_finds_what_the_regular_expression_finds(spark):
    """Words that end at a text's end, empty texts, characters on either side of each border, and a slice."""
    odd = ["", "ab", "cd e", "  ", "x\u4dffy\u4e00\u9fff\ua000z", "\uac00a\U0001f600b\u00e9c\u2026", "_1-2_", "一二", "三", "\u30a2\uff21A\x00b", "Z\u8fff", "", "9"]
    rng = random.Random(8)
    odd += ["".join(rng.choice("aZ09 /:@[`{\u3fff\u4dbf\u4dff\u4e00\u5000\u8fff\u9fff\ua000\uffff\U00010000é\n") for _ in range(rng.randrange(30))) for _ in range(300)]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(odd)), "i int, t string").orderBy("i").select(runs(F.col("t"))).collect()]
    for kind in (pa.string(), pa.large_string()):
        words, n = postings.cut(pa.array(["before", *odd, "after"], kind).slice(1, len(odd)))
        assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]
    assert postings.cut(pa.array([], pa.string()))[0].to_pylist() == [] and postings.cut(pa.array([""]))[1].tolist() == [0]


@pytest.mark.parametrize("size", [37, 100_000])
def test_scan_finds_what_the_index_finds(spark, monkeypatch, size):
    """Several parts, blocks and slices of a batch; documents without text, null texts, words that nobody has, allowed documents."""
    monkeypatch.setattr(postings, "TEXTS", size)
    for name in ("PART_ROWS", "PART_DOCS", "BLOCK_ROWS"):
        monkeypatch.setattr(parts, name, size)
    docs, asked = test_indexes.documents(1, 120), test_indexes.asked_of(3)
    rows = [(i, t, (" ".join(a) or None, "/".join(b).upper())) for i, (t, a, b) in docs.items()] + [(None, 0, ("w1", "w1"))]
    queries = spark.createDataFrame(asked, "item_id bigint, term string")
    scan = postings.TextScan(spark.createDataFrame(rows, "doc_id bigint, tie bigint, fields struct<title:string,body:string>"), queries, ["title", "body", "both"], {"both": ("title", "body")})
    test_indexes.check(spark, scan, docs)
    allowed = {i for i in docs if i % 3 == 0}
    got = scan.top(queries, test_indexes.WEIGHTS, 5, allowed=spark.createDataFrame([(i,) for i in allowed], "doc_id bigint"))
    assert sorted(tuple(r)[:2] for r in got.collect()) == [w[:2] for w in test_indexes.expected(docs, asked, 5, True, True, allowed)]
    held = {i: {t for _, t in asked} & set(d[1]) & set(d[2]) for i, d in docs.items()}
    points = {i: len(held[i] & {t for q, t in asked if q == 0}) for i in docs}
    found = scan.top(queries.filter("item_id = 0"), {"both": 3.0}, 1_000, bm25=False, best_field=False)
    assert {r["doc_id"]: r["score"] for r in found.collect()} == {i: 3.0 * n for i, n in points.items() if n}
    none = postings.TextScan(spark.createDataFrame(rows[:0], "doc_id bigint, tie bigint, fields struct<title:string,body:string>"), queries, ["title"])
    assert none.top(queries, test_indexes.WEIGHTS, 3).count() == 0


SCANNING = ["bm25_topk", "sample_recall", "per_tenant_cap", "rerank_local", "evidence_pack", "prioritized_hits", "kw_topk_documents", "kw_topk_permitted", "rrf_weighted", "rrf_classic", "merge_unique", "bm25_four_fields", "compared_rankings"]


@pytest.mark.parametrize("name", SCANNING)
def test_a_search_for_few_words_writes_no_index_of_all(spark, small, monkeypatch, name):
    monkeypatch.setattr(postings.TextIndex, "add", None)
    monkeypatch.setattr(search, "library_index", None)
    assert difference(spark, connect(small), catalog.queries()[name], catalog.oracle_sql()[name], small) == ""


def test_key_words_from_the_first_characters(spark):
    """Texts with enough of them there, with the last of them cut, with too few, with none."""
    many = [f"Word{i}" for i in range(14)]
    texts = [" ".join(many[:n]) + " word0" * m + " Then next NEXT 一二三 end" for n in (0, 3, 11, 12, 13, 14) for m in (0, 2, 500)]
    texts += [" ".join(many[:n]).ljust(1_997, "-") + "abcdefg more" for n in (11, 12, 13)] + ["", None, "a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(keywords(F.col("t")), F.lower).alias("a"), search.key_words(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_shaped_hits_cuts_only_hits_to_chunks(spark, small, monkeypatch):
    whole, asked = scores.chunks, []
    wanted = spark.createDataFrame([(3,), (5,), (5,), (None,)], "doc_id bigint")
    want = whole(spark, small).filter("doc_id IN (3, 5)")
    assert sorted(map(tuple, whole(spark, small, wanted).collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(scores, "chunks", lambda spark, sf_dir, wanted=None: asked.append(wanted) or whole(spark, sf_dir, wanted))
    scores.shaped_hits(spark, small)
    assert asked[0].select("doc_id").distinct().count() > 0


def test_sentence_groups_hash_a_word_once(monkeypatch):
    """Groups as sentence by sentence, from exact sums; a word that comes again is not hashed again."""
    rng = random.Random(9)
    texts = [[" ".join(rng.choice(("the", "The", "cat", "sat", "一二", "--", f"n{rng.randrange(40)}")) for _ in range(rng.choice((0, 1, 4, 30)))) for _ in range(n)] for n in (0, 1, 2, 60, 200)]
    chunking.word_bytes.cache_clear()
    hashed, sha256 = [], chunking.hashlib.sha256
    monkeypatch.setattr(chunking.hashlib, "sha256", lambda w: hashed.append(w) or sha256(w))
    got = [chunking.grouped(t, 60, least) for t in texts for least in (0.0, 0.72, 0.95)]
    assert len(hashed) == len(set(hashed)) > 40

    def plain(sentences, most, least):
        out, first = [], 0
        vectors = [np.tile(sum((np.frombuffer(sha256(w.encode()).digest(), dtype=np.uint8).astype(float) for w in chunking.WORD.findall(s.lower())), np.zeros(32)), 2) for s in sentences]
        size = lambda a, b: max(sum(len(s.split()) for s in sentences[a:b]), sum(len(chunking.UNIT.findall(s)) for s in sentences[a:b]))
        for i in range(1, len(sentences)):
            u, v = vectors[i - 1 : i + 1]
            if size(first, i + 1) > most or (u @ v) / (np.sqrt((u @ u) * (v @ v)) or 1.0) < least:
                out.append((first, i - first, size(first, i)))
                start = i - 1
                while start > first and size(start, i) < 9:
                    start -= 1
                first = start
        return out + ([(first, len(sentences) - first, size(first, len(sentences)))] if sentences else [])

    assert got == [plain(t, 60, least) for t in texts for least in (0.0, 0.72, 0.95)]


def test_sentences_of_a_text_equal_the_column_form(spark):
    rng = random.Random(10)
    odd = ["", " . ", "a..b", "a.\nb", "a.\n\nb\n", "\n\n", "x\r\ny\u2028z. \u3000q\u3000", "一。二！三", "\x1ca\x1f.\x85b\x85", "\u200ba\u180e;\u2060"]
    odd += ["".join(rng.choice("ab.!?;。 \n\r\t\x0b\x1c\x1f\x85\xa0\u180e\u2003\u2028\u202f\ufeff") for _ in range(rng.randrange(40))) for _ in range(400)]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(odd)), "i int, t string").orderBy("i").select(sentences(F.col("t"))).collect()]
    assert [chunking.sentences_of(t) for t in odd] == want


@pytest.mark.parametrize("docs_of_part", [7, 16_384])
def test_scan_adds_up_postings_where_they_are(spark, monkeypatch, docs_of_part):
    """Few queries: parts of a few rows, and no posting is shuffled; where an id comes again its postings are added up as before."""
    monkeypatch.setattr(parts, "PART_DOCS", docs_of_part)
    docs, asked = test_indexes.documents(1, 120), test_indexes.asked_of(3)
    schema = "doc_id bigint, tie bigint, fields struct<title:string,body:string>"
    rows = [(i, t, (" ".join(a) or None, "/".join(b).upper())) for i, (t, a, b) in docs.items()] + [(None, 0, ("w1", "w1"))]
    queries = spark.createDataFrame(asked, "item_id bigint, term string")
    scan = postings.TextScan(spark.createDataFrame(rows, schema), queries, ["title", "body"])
    test_indexes.check(spark, scan, docs)
    plan = lambda s: s.top(queries, test_indexes.WEIGHTS, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan(scan) and "CoGroup" not in plan(scan) and "Join" not in plan(scan)
    allowed = {i for i in docs if i % 3 == 0}
    got = scan.top(queries, test_indexes.WEIGHTS, 5, allowed=spark.createDataFrame([(i,) for i in allowed], "doc_id bigint"))
    assert sorted(tuple(r)[:2] for r in got.collect()) == [w[:2] for w in test_indexes.expected(docs, asked, 5, True, True, allowed)]
    again = postings.TextScan(spark.createDataFrame([*rows, rows[3]], schema), queries, ["title", "body"])
    found = [tuple(r)[:2] for r in again.top(queries, test_indexes.WEIGHTS, 1_000).collect()]
    assert "CoGroup" in plan(again) and len(found) == len(set(found)) > 100
    none = postings.TextScan(spark.createDataFrame(rows[:0], schema), queries, ["title"])
    assert none.top(queries, test_indexes.WEIGHTS, 3).count() == 0


@pytest.mark.parametrize("name", ["prioritized_hits", "per_tenant_cap", "rerank_local", "evidence_pack"])
def test_titles_are_cut_from_hits_only(spark, small, monkeypatch, name):
    """The text is split and lower-cased above the join that leaves the hits' documents; many hits shuffle no texts."""
    above, below = catalog.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")
    assert "split(text" in above and "split(text" not in below
    monkeypatch.setattr(search, "few_hits", lambda *_: False)
    many = catalog.queries()[name](spark, small)
    assert "LeftSemi" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert difference(spark, connect(small), lambda *_: many, catalog.oracle_sql()[name], small) == ""


@pytest.mark.parametrize("block_rows", [1, 500_000])
def test_a_query_without_id_finds_what_it_finds_with_one(spark, monkeypatch, block_rows):
    """As in SQL a null id is a query of its own, whether postings are added up in parts or in place."""
    monkeypatch.setattr(parts, "BLOCK_ROWS", block_rows)
    docs, asked = test_indexes.documents(1, 120), test_indexes.asked_of(3)
    rows = [(i, t, (" ".join(a), "/".join(b))) for i, (t, a, b) in docs.items()]
    queries = spark.createDataFrame([*asked, *((None, t) for q, t in asked if q == 1)], "item_id bigint, term string")
    scan = postings.TextScan(spark.createDataFrame(rows, "doc_id bigint, tie bigint, fields struct<title:string,body:string>"), queries, ["title", "body"])
    found = [tuple(r) for r in scan.top(queries, test_indexes.WEIGHTS, 5).collect()]
    bare = sorted(r[1:] for r in found if r[0] is None)
    assert bare and bare == sorted(r[1:] for r in found if r[0] == 1)
    assert {r[0] for r in found} == {None, *(q for q, _ in asked)}


@pytest.mark.parametrize("name", ["sample_recall", "bm25_topk"])
def test_searches_of_odd_queries(spark, small, tmp_path, name):
    """Items without id, text or words."""
    for path in pathlib.Path(small).iterdir():
        (tmp_path / path.name).symlink_to(path)
    (tmp_path / "benchmark.parquet").unlink()
    items = pq.read_table(f"{small}/benchmark.parquet").select(["item_id", "text"])
    odd = pa.table({"item_id": [None, 9001, 9002, 9003], "text": [items["text"][0].as_py(), None, "", "...!"]}, schema=items.schema)
    pq.write_table(pa.concat_tables([items, odd]), tmp_path / "benchmark.parquet")
    assert difference(spark, connect(str(tmp_path)), catalog.queries()[name], catalog.oracle_sql()[name], str(tmp_path)) == ""


@pytest.mark.parametrize("docs_of_part", [7, 16_384])
@pytest.mark.parametrize("name", ["hybrid_search", "rerank_full"])
def test_a_search_for_titles_keeps_no_postings(spark, small, monkeypatch, name, docs_of_part):
    """Titles and vectors ask: the texts are searched in one pass, in parts of a few documents, and no index of all words or list of counts is written."""
    monkeypatch.setattr(postings.TextIndex, "add", None)
    monkeypatch.setattr(search, "library_index", None)
    monkeypatch.setattr(search, "TextScan", None)
    monkeypatch.setattr(parts, "PART_DOCS", docs_of_part)
    monkeypatch.setattr(postings, "TEXTS", 5)
    assert difference(spark, connect(small), catalog.queries()[name], catalog.oracle_sql()[name], small) == ""


@pytest.mark.parametrize("docs_of_part", [7, 16_384])
def test_scan_top_finds_what_the_scan_finds(spark, monkeypatch, docs_of_part):
    """Ties, queries of the same words, without id, without words that are found, null texts; an id that comes again is left to the scan."""
    monkeypatch.setattr(parts, "PART_DOCS", docs_of_part)
    monkeypatch.setattr(postings, "TEXTS", docs_of_part)
    docs, asked = test_indexes.documents(1, 120), test_indexes.asked_of(3)
    schema = "doc_id bigint, tie bigint, fields struct<title:string,body:string>"
    rows = [(i, t, (" ".join(a) or None, "/".join(b).upper())) for i, (t, a, b) in docs.items()] + [(None, 0, ("w1", "w1"))]
    asked += [(q, t) for p, t in asked for q in (None, 77) if p == 1] + [(78, "nobody")]
    queries, shared, weights = spark.createDataFrame(asked, "item_id bigint, term string"), {"both": ("title", "body")}, {"body": 2.0, "both": 3.0, "title": 0.5}
    fields = ["title", "body", "both"]
    frame = spark.createDataFrame(rows, schema).repartition(2)
    for k in (1, 5, 1_000):
        want = postings.TextScan(frame, queries, fields, shared).top(queries, weights, k, bm25=False, best_field=False)
        got = postings.scan_top(frame, queries, fields, shared, weights, k)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.filter("item_id IS NULL").count() > 0
    assert postings.scan_top(spark.createDataFrame([*rows, rows[3]], schema), queries, fields, shared, weights, 5) is None
    assert postings.scan_top(frame.limit(0), queries, fields, shared, weights, 5).count() == 0
    assert postings.scan_top(frame, queries.limit(0), fields, shared, weights, 5).count() == 0
