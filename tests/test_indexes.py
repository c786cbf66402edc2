"""The text and vector indexes against plain Python, with updates and deletes."""

import math
import random
from collections import Counter, defaultdict

import pytest
from inkwell.operators import cells, postings
from inkwell.plans.snapshots import Snapshots
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, tie bigint, fields struct<title:array<string>,body:array<string>>"
WEIGHTS = {"title": 3.0, "body": 1.0}


def documents(seed, n, first=0):
    """Token lists with a skewed vocabulary, very common words, empty fields and equal documents."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.05)), 150)}"
    out = {}
    for i in range(first, first + n):
        body = [word() for _ in range(rng.choice((0, 3, 30, 200)))] + ["the"] * rng.choice((0, 1, 5))
        out[i] = (rng.randrange(3), [word() for _ in range(rng.choice((0, 2, 6)))], body)
    out[first + n] = out[first + 1]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, (a, b)) for i, (t, a, b) in docs.items()], SCHEMA)


def expected(docs, asked, k, bm25, best_field, allowed=None):
    n, out = len(docs), []
    df = {f: Counter(t for d in docs.values() for t in set(d[1 + f])) for f in (0, 1)}
    mean = [sum(len(d[1 + f]) for d in docs.values()) / n for f in (0, 1)]
    by_item = defaultdict(set)
    for item, term in asked:
        by_item[item].add(term)
    for item, terms in by_item.items():
        found = []
        for i, d in docs.items():
            if allowed is not None and i not in allowed:
                continue
            score = [0.0, 0.0]
            for f, weight in enumerate((3.0, 1.0)):
                tf = Counter(d[1 + f])
                for t in terms & set(tf):
                    idf = math.log(1 + (n - df[f][t] + 0.5) / (df[f][t] + 0.5))
                    score[f] += weight * (idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d[1 + f]) / mean[f])) if bm25 else 1)
            total = round(max(score) if best_field else sum(score), 6)
            if total > 0:
                found.append((-total, d[0], i))
        out += [(item, i, -s, r + 1) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def asked_of(seed):
    rng = random.Random(seed)
    return sorted({(q, t) for q in range(8) for t in ["the", "nowhere", *(f"w{min(int(rng.expovariate(0.04)), 160)}" for _ in range(rng.choice((1, 4, 20))))]})


def check(spark, index, docs, k=5):
    asked = asked_of(3)
    queries = spark.createDataFrame(asked, "item_id bigint, term string")
    for bm25, best_field in ((True, True), (False, False), (True, False)):
        got = sorted(tuple(r) for r in index.top(queries, WEIGHTS, k, bm25, best_field).collect())
        want = expected(docs, asked, k, bm25, best_field)
        assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6), (bm25, best_field)


@pytest.mark.parametrize("seed_rows", [1, 50, -1])
def test_text_index_with_updates(spark, tmp_path, monkeypatch, seed_rows):
    """A small seed gives low floors, so all steps are at work."""
    monkeypatch.setattr(postings, "SEED_ROWS", abs(seed_rows))
    if seed_rows > 0:  # the three steps
        monkeypatch.setattr(postings, "WHOLE_ROWS", -1)
    docs = documents(1, 120)
    index = postings.TextIndex(Snapshots(spark, str(tmp_path / "i")), buckets=3)
    index.add(frame(spark, docs))
    check(spark, index, docs)
    if seed_rows == 1:
        return
    new = documents(2, 30, 100)  # replaces some, adds others
    index.add(frame(spark, new))
    docs = docs | new
    check(spark, index, docs)
    index.delete(spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(10**9,)], "doc_id bigint"))
    docs = {i: d for i, d in docs.items() if i >= 60 or i % 2}
    check(spark, index, docs)
    before = index.postings().count()
    index.compact()
    assert index.postings().count() < before and not index.store.manifest()["notes"]["dead"]
    check(spark, index, docs)
    allowed, asked = {i for i in docs if i % 3 == 0}, asked_of(3)
    got = index.top(spark.createDataFrame(asked, "item_id bigint, term string"), WEIGHTS, 5, allowed=spark.createDataFrame([(i,) for i in allowed], "doc_id bigint"))
    assert sorted(tuple(r)[:2] for r in got.collect()) == [w[:2] for w in expected(docs, asked, 5, True, True, allowed)]


def test_text_index_of_nothing(spark, tmp_path):
    index = postings.TextIndex(Snapshots(spark, str(tmp_path / "i")), buckets=2)
    index.add(spark.createDataFrame([(1, 0, ([], [])), (None, 0, (["a"], ["a"]))], SCHEMA))
    assert index.top(spark.createDataFrame([(1, "a")], "item_id bigint, term string"), WEIGHTS, 3).count() == 0
    assert index.top(spark.createDataFrame([], "item_id bigint, term string"), WEIGHTS, 3).count() == 0


def test_counted_tokens(spark):
    row = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>").select(postings.counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r["c"]] for r in row] == [[("a", 1), ("b", 2)], []]


def vectors(seed, n, dim=8, first=0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = {i: [m + rng.gauss(0, 0.2) for m in middles[min(int(rng.expovariate(1)), 5)]] for i in range(first, first + n)}
    rows |= {first + n: [0.0] * dim, first + n + 1: rows[first], first + n + 2: [2 * x for x in rows[first]]}
    return rows


def nearest(rows, queries, k, allowed=None):
    unit = lambda v: [x / s for x in v] if (s := math.sqrt(sum(x * x for x in v))) else v
    units, out = {i: unit(v) for i, v in rows.items()}, []
    for q, v in queries.items():
        found = sorted((-round(sum(a * b for a, b in zip(unit(v), u, strict=True)), 6), i) for i, u in units.items() if allowed is None or i in allowed)[:k]
        out += [(q, i) for _, i in found]
    return sorted(out)


def search(spark, index, queries, k, allowed=None):
    from inkwell.operators.search import cosine_ranked

    asked = spark.createDataFrame(list(queries.items()), "id bigint, v array<double>")
    ids = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "id bigint")
    return sorted((r["query_id"], r["vec_id"]) for r in cosine_ranked(index, asked, k, ids).collect())


def test_vector_index_with_updates(spark, tmp_path, monkeypatch):
    """Parts and blocks of a few rows, so that every cell is split."""
    monkeypatch.setattr(cells, "CHUNK", 40)
    monkeypatch.setattr(cells, "BLOCK", 7)
    rows, queries = vectors(1, 300), vectors(2, 20)
    index = cells.VectorIndex(Snapshots(spark, str(tmp_path / "v")))
    frame_of = lambda d: spark.createDataFrame([*d.items(), (None, [1.0] * 8)], "id bigint, v array<double>")
    index.write(frame_of(rows))
    assert search(spark, index, queries, 5) == nearest(rows, queries, 5)
    allowed = set(range(0, 300, 3))
    assert search(spark, index, queries, 4, allowed) == nearest(rows, queries, 4, allowed)
    new = vectors(3, 40, first=280)
    index.add(frame_of(new))
    rows |= new
    index.delete(spark.createDataFrame([(i,) for i in range(100)], "id bigint"))
    rows = {i: v for i, v in rows.items() if i >= 100}
    assert search(spark, index, queries, 5) == nearest(rows, queries, 5)


def test_most_cells_are_left_out(spark, tmp_path):
    rng = random.Random(5)
    rows = {i: [float(j == i % 12) + rng.gauss(0, 0.02) for j in range(12)] for i in range(600)}
    index = cells.VectorIndex(Snapshots(spark, str(tmp_path / "v")))
    index.write(spark.createDataFrame(list(rows.items()), "id bigint, v array<double>"), cells=12)
    n = {r["cell"]: r["n"] for r in index.store.read("cells").collect()}
    queries = {i: rows[i] for i in range(12)}
    assert search(spark, index, queries, 3) == nearest(rows, queries, 3) and len(n) > 8


@pytest.mark.parametrize("tiles", [1, 16])
def test_vector_search_makes_no_row_for_a_query_and_a_cell(spark, tmp_path, monkeypatch, tiles):
    """Queries and rows are dealt once for each part and block, however many cells a query visits; tiles of a few rows, many equal vectors, fewer rows than asked for."""
    for name, n in (("CHUNK", 16), ("BLOCK", 7), ("TILE", 5), ("PART_TILES", tiles), ("BLOCK_TILES", tiles)):
        monkeypatch.setattr(cells, name, n, raising=False)
    rng = random.Random(7)
    rows = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(200)} | {i: [1.0, 2.0] * 4 for i in range(200, 320)} | {320: [0.0] * 8, 321: [-1.0, -2.0] * 4}
    queries = {i: rows[i] for i in range(0, 322, 8)} | {1_000: [0.0] * 8, 1_001: [2.0, 4.0] * 4}
    index = cells.VectorIndex(Snapshots(spark, str(tmp_path / "v")))
    index.write(spark.createDataFrame(list(rows.items()), "id bigint, v array<double>"), cells=9)
    for k in (1, 6, 150):
        assert search(spark, index, queries, k) == nearest(rows, queries, k)
    few = set(range(0, 320, 100))
    assert search(spark, index, queries, 6, few) == nearest(rows, queries, 6, few)
    plan = index.top(spark.createDataFrame(list(queries.items()), "id bigint, v array<double>"), 6)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan and plan.count("Exchange") == 2


def test_vector_index_of_nothing(spark, tmp_path):
    index = cells.VectorIndex(Snapshots(spark, str(tmp_path / "v")))
    index.write(spark.createDataFrame([], "id bigint, v array<double>"))
    assert search(spark, index, {1: [1.0, 0.0]}, 3) == []
