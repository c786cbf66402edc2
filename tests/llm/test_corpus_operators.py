"""Mixing, sharding, URL filters and the pipeline, against plain Python on small tables with the hard cases."""

import hashlib
import itertools
import random
import struct
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import xxhash
from inkwell.llm import chat_preference, decontaminate, fm_index, license_scan, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, textops, url_filters
from inkwell.llm.queries import queries
from pyspark.sql import functions as F

from tests.llm import samples


def test_targets_share_out_what_caps_cut_off():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    got = mixing.targets([10, 1000, 1000], [3, 1, 1])
    assert got[0] == 30.0 and got[1] == got[2] == pytest.approx(990.0)
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_flow_spreads_repeats_and_fills_overlapping_sources():
    # One pattern of both sources and one of the second alone: the second can leave the shared one to the first.
    assert mixing.flow([100, 100], [[0, 1], [1]], [100, 100]) == [100, 100]
    # Repetition is convex: two patterns give their second copies before either gives a third.
    got = mixing.flow([100, 100], [[0], [0]], [400])
    assert got == [200, 200]
    assert mixing.flow([100], [[0]], [1000]) == [300]


def least_cost(supply, members, quotas, copies):
    """(most words, their least cost) by trying every amount of every pattern; feasible if each set of sources has room for the patterns that need it."""
    best = (0, 0)
    for amounts in itertools.product(*(range(copies * s + 1) for s in supply)):
        ok = all(
            sum(a for a, m in zip(amounts, members) if set(m) <= set(some)) <= sum(quotas[s] for s in some)
            for k in range(1, len(quotas) + 1) for some in itertools.combinations(range(len(quotas)), k)
        )
        if ok:
            cost = sum(k * min(s, max(0, a - k * s)) for a, s in zip(amounts, supply) for k in range(copies))
            best = max(best, (sum(amounts), -cost))
    return best[0], -best[1]


def test_flow_is_the_cheapest_of_the_greatest():
    rng = random.Random(3)
    for _ in range(25):
        n_s = rng.choice((2, 3))
        members = [sorted(rng.sample(range(n_s), rng.randint(1, n_s))) for _ in range(4)]
        supply, quotas = [rng.randint(0, 2) for _ in members], [rng.randint(0, 6) for _ in range(n_s)]
        got = mixing.flow(supply, members, quotas, 3)
        cost = sum(k * min(s, max(0, a - k * s)) for a, s in zip(got, supply, strict=True) for k in range(3))
        assert (sum(got), cost) == least_cost(supply, members, quotas, 3), (supply, members, quotas, got)
        assert all(a <= 3 * s for a, s in zip(got, supply, strict=True))


def test_more_patterns_than_the_driver_holds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    with pytest.raises(ValueError, match="group the sources"):
        mixing.mix(samples.frame(spark, samples.documents()), F.array("source"))


def test_registered_mix(spark, small):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    names = sorted({r["source"] for r in rows.values()}, key=lambda s: (s is None, s))
    size = {d: len(samples.WORD.findall(r["text"] or "")) for d, r in rows.items()}
    total = {s: sum(size[d] for d, r in rows.items() if r["source"] == s) for s in names}
    goals = dict(zip(names, mixing.targets([total[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    out = queries()["op6_mix_sources"](spark, small).collect()
    for r in out:
        s = rows[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(goals[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    longest = max(size.values())
    assert len(out) == len(rows) and all(abs(taken[s] - goals[s]) <= max(0.01 * goals[s], longest) for s in names)


def test_mixing_hits_targets(spark):
    rows = samples.documents(seed=2, n=200)
    out, sources = mixing.mix(samples.frame(spark, rows), F.array("source"))
    got = out.select("doc_id", "source", "text", "size", "copies").collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    goals = {r["source"]: r["target"] for r in sources.collect()}
    assert sum(goals.values()) == pytest.approx(sum(r["size"] for r in got))
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 0.1 * goal + 20, (s, taken[s], goal)
    again = {(r["doc_id"], r["text"], r["copies"]) for r in mixing.mix(samples.frame(spark, rows[::-1]), F.array("source"))[0].select("doc_id", "text", "copies").collect()}
    assert again == {(r["doc_id"], r["text"], r["copies"]) for r in got}


def test_mixing_overlapping_sources(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j").alias("text"), F.when(F.col("id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("in"))
    out, _ = mixing.mix(docs, F.col("in"), weights=(1, 1))
    assert abs(out.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] - 3000) <= 40


def test_mixing_fills_what_a_long_text_leaves(spark):
    docs = spark.range(3001).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") == 0, 60_000).otherwise(40).cast("int")).alias("text"), F.lit("s").alias("source")).repartition(4)
    for seed in (1, 2, 3):
        out, _ = mixing.mix(docs, F.array("source"), seed=seed, share=0.5)
        taken, most = out.agg(F.sum(F.col("size") * F.col("copies")), F.max("copies")).first()
        assert most == 1 and 0.995 * 90_000 <= taken <= 90_000, (seed, taken)


def test_mixing_repeats_short_texts_where_one_text_is_over_the_rest(spark):
    docs = spark.range(11).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") == 0, 9000).otherwise(100).cast("int")).alias("text"), F.lit("s").alias("source"))
    out, _ = mixing.mix(docs, F.array("source"), share=0.5)
    assert {r["doc_id"]: r["copies"] for r in out.collect()} == {0: 0} | {i: 3 for i in range(1, 11)}


def test_mixing_no_rows(spark):
    out, _ = mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string"), F.array("source"))
    assert out.count() == 0


def test_table_is_full_even_and_stable():
    names = [f"n{i}" for i in range(10)]
    before = sharding.fill(names, 1009)
    share = Counter(before)
    assert set(share) == set(range(10)) and max(share.values()) - min(share.values()) <= 1
    after = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    weighted = Counter(sharding.fill(names, 1009, turns=[3] + [1] * 9))
    assert weighted[0] > 2 * weighted[1]
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_table_equals_preference_lists():
    """The published filling rule, with the preference lists written out in full."""
    names, slots = [f"s{i}" for i in range(13)], 211
    lists = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        lists.append([(offset + j * skip) % slots for j in range(slots)])
        assert sorted(lists[-1]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for i, wanted in enumerate(lists):
            if len(owner) < slots:
                owner[next(x for x in wanted if x not in owner)] = i
    assert sharding.fill(names, slots) == [owner[x] for x in range(slots)]


def test_registered_placement_by_an_independent_hash(spark, small):
    owner = sharding.fill([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    start = xxhash.xxh64_intdigest(struct.pack("<i", sharding.SEED), seed=42)
    got = queries()["op2_shard"](spark, small).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in got:
        h = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), seed=start)
        slot = (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS
        assert (r["slot"], r["shard"], r["n_bytes"]) == (slot, owner[slot], len((text[r["doc_id"]] or "").encode()))


def test_placement(spark, tmp_path):
    rows = samples.documents()
    placed = sharding.place(samples.frame(spark, rows), F.col("doc_id"), F.col("text"), [f"s{i}" for i in range(7)], 211)
    got = placed.select("doc_id", "text", "slot", "shard").collect()
    owner = sharding.fill([f"s{i}" for i in range(7)], 211)
    assert len(got) == len(rows) and all(owner[r["slot"]] == r["shard"] for r in got)
    by_id = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    sharding.write_shards(placed.drop("h"), str(tmp_path / "out"), pieces=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def judged(url, rules=url_filters.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut].translate(samples.FOLD), rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://A.example.COM/en/1", "https://a.example.com/en/7/x?y", "x://example.com/en/70", "https://b.example.net/de/8", "http://net/de/", "http://notnet/de/", "http://x.org/es/#z", "http://host?q/en/", "no scheme", "", None, "http://a.com:80/en/x", "http:///path", "http://h.com", "a://b://c.org/es/", "http://q.com/fr/en/"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)] + [(0, URLS[0], None)], "page_id bigint, url string, html string").withColumn("host", F.lit("own"))
    for r in url_filters.judge(pages).collect():
        host, path, rule, verdict = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]), r
        assert r["verdict"] in ("allow", "block")


def test_distrust_flows_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a class="l" href="https://{h}/p">x</a>' for h in hosts) + '<a href="/local">y</a>'
    rows = [(1, "https://bad.com/en/1", ""), (2, "https://links-bad.io/1", link("bad.com", "bad.com")), (3, "https://far.io/1", link("links-bad.io")), (4, "https://good.net/de/1", link("friend.io") + "<A HREF='//other.io/x'>"), (5, "https://friend.io/", link("other.io", "good.net", "good.net")), (6, "https://other.io/", ""), (7, "https://alone.io/", None)]
    rows += [(5, "https://friend.io/z", None)]
    out = {r["page_id"]: r["verdict"] for r in url_filters.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def scores_by_power_iteration(links, mass, damping=url_filters.DAMPING, rounds=400):
    total, rank = Counter(), dict(mass)
    for (s, _), n in links.items():
        total[s] += n
    for _ in range(rounds):
        new = {h: (1 - damping) * m for h, m in mass.items()}
        for (s, t), n in links.items():
            new[t] = new.get(t, 0) + damping * rank.get(s, 0) * n / total[s]
        rank = new
    return rank


@pytest.mark.parametrize("hub", [50_000, 2])
def test_verdicts_of_a_random_graph(spark, monkeypatch, hub):
    """Hosts with rules of both kinds, cycles, a hub, and a chain of 12 hosts that leads to a blocked one."""
    monkeypatch.setattr(url_filters, "HUB_LINKS", hub)
    monkeypatch.setattr(url_filters, "TOLERANCE", 1e-4)
    rng = random.Random(7)
    hosts = [f"h{i}.{rng.choice(('com', 'net', 'io', 'io', 'io'))}" for i in range(24)] + [f"chain{i}.io" for i in range(12)] + ["end.org"]
    to = {h: rng.sample(hosts[:24], rng.randint(0, 4)) for h in hosts[:24]} | {f"chain{i}.io": [f"chain{i + 1}.io" if i < 11 else "end.org"] for i in range(12)}
    to[hosts[0]] = hosts[1:20]
    rows = []
    for h in hosts:
        path = {"com": "/en/1", "net": "/de/1", "org": "/es/1"}.get(h.rsplit(".", 1)[1], "/x")
        rows += [(len(rows), f"https://{h}{path}", "".join(f'<a href="http://{t}/p">' for t in to.get(h, ()))), (len(rows) + 1, f"https://{h}/free", None)]
    links = Counter((h, t) for h in hosts for t in to.get(h, ()) if h != t)
    mass = {kind: {h: 1.0 for h in hosts if h.rsplit(".", 1)[1] in ends} for kind, ends in (("trust", ("net",)), ("distrust", ("com", "org")))}
    trust, distrust = scores_by_power_iteration(links, mass["trust"]), scores_by_power_iteration({(t, s): n for (s, t), n in links.items()}, mass["distrust"])
    margin = {h: distrust.get(h, 0) - trust.get(h, 0) for h in hosts}
    assert margin["chain0.io"] > 1e-2
    out = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), tolerance=1e-4).collect()}
    for page_id, url, _ in rows:
        host, _, rule, verdict = judged(url)
        if verdict or abs(margin[host] - 1e-4) > 2e-3:
            assert out[page_id]["verdict"] == (verdict or ("block" if margin[host] > 1e-4 else "allow")), (url, margin[host])


@pytest.mark.parametrize("salted", [False, True])
def test_propagation_equals_power_iteration(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(url_filters, "HUB_LINKS", 1)
    links = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 3, ("c", "a"): 1, ("d", "a"): 4}
    edges = url_filters.shares(spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n bigint"), "trust")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("trust", "d", 0.5)], "kind string, host string, mass double")
    got = {r["host"]: r["score"] for r in url_filters.propagate(edges, seeds, tolerance=1e-3).collect()}
    assert got == pytest.approx(scores_by_power_iteration(links, {"a": 1.0, "d": 0.5}), abs=2e-3)


def test_operators_take_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert url_filters.judge(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert substring_dedup.dedup_substrings(docs).count() == 0 and line_dedup.drop_common_lines(docs).count() == 0
    assert license_scan.scan_licenses(docs).count() == 0 and quality_rules.judge(docs).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_preference.format_preferences(turns, F.col("conv_id"), F.lit(True)).count() == 0


#: Columns whose names or types an operator could stumble on.
def odd_columns():
    return {
        "Shard": F.lit("own"), "SLOT": F.lit(3), "a.b": F.col("doc_id") * 2, "back`tick": F.lit(1), "tags": F.create_map(F.lit("k"), F.col("source")), "parts": F.array(F.struct(F.col("lang").alias("x"), F.lit(1).alias("y"))),
        "Kept": F.lit(True), "N_Words": F.lit(1), "_row": F.lit("r"), "_ID": F.lit(7), "Component_Id": F.lit(0), "copies": F.lit(9), "size": F.lit("s"),
    }


def odd_documents(spark, small):
    """Documents with such columns, with repeated and null ids."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    nulls = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    return docs.unionByName(docs.limit(15)).unionByName(nulls).withColumns(odd_columns())


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_of_any_name_and_type(spark, small, tmp_path, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = odd_documents(spark, small)
    stage(spark, docs, small).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ([*[c for c in docs.columns if c.lower() != "shard"], "shard"] if name == "shard" else docs.columns)
    known = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    rows = out.collect()
    assert rows and all(all(r[c] == known[r["doc_id"], r["text"]][c] for c in docs.columns if c.lower() != "shard") for r in rows)


@pytest.mark.parametrize("name", ["place", "decontaminate", "judge", "mix", "drop_common_lines"])
def test_public_functions_take_columns_of_any_name_and_type(spark, small, tmp_path, name):
    docs = odd_documents(spark, small)
    out = {
        "place": lambda: sharding.place(docs, F.col("doc_id"), F.col("text")), "judge": lambda: quality_rules.judge(docs), "drop_common_lines": lambda: line_dedup.drop_common_lines(docs),
        "decontaminate": lambda: decontaminate.decontaminate(docs, spark.read.parquet(f"{small}/benchmark.parquet")), "mix": lambda: mixing.mix(docs, F.array("source"))[0],
    }[name]()
    out.write.parquet(str(tmp_path / "out"))
    assert out.count() == docs.count() and {"a.b", "back`tick", "tags", "parts", "_row"} <= set(out.columns)


def test_runs_in_two_threads_clean_their_own_tables(spark):
    from threading import Thread

    from inkwell.llm import common

    mine, theirs = common.written(spark.range(3).toDF("x")), []

    def other():
        theirs.append(common.written(spark.range(4).toDF("x")))
        common.clean(spark)

    thread = Thread(target=other)
    thread.start()
    thread.join()
    assert mine.count() == 3 and len(theirs) == 1
    common.clean(spark)


def test_near_duplicate_stage_keeps_one_row_of_an_id_and_reruns_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    twice = docs.withColumns({"text": F.concat(F.lit("something quite different from all the rest "), F.col("source"), F.lit(" "), F.col("doc_id")), "_tk": F.lit(1)})
    both = docs.withColumn("_tk", F.lit(2)).unionByName(twice)
    runs = [sorted(map(tuple, near_dedup.stage(spark, df, small).collect()), key=repr) for df in (both, both.repartition(5), both.orderBy(F.desc("_tk")).coalesce(1))]
    assert runs[0] == runs[1] == runs[2] and len({r[0] for r in runs[0]}) == len(runs[0]) and runs[0][0][-1] in (1, 2)


def test_word_hashes_do_not_depend_on_pieces():
    texts = [b"a bb  ccc\tD", None, b"", b"  ", b"x" * 3000, "é ü".encode(), b"a bb"]
    whole, at = textops.word_hashes(texts, lower=False)
    cut, at_cut = textops.word_hashes(texts, lower=False, step=3)
    assert list(whole) == list(cut) and list(at) == list(at_cut) == [0, 4, 4, 4, 4, 5, 7, 9]
    assert list(whole[:2]) == list(whole[7:]) and len(set(whole.tolist())) == 7
    assert list(textops.gram_hashes(whole[:2], 2)) == list(textops.gram_hashes(whole[7:], 2)) and len(textops.gram_hashes(whole, 3)) == 7


def test_fm_index_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    parts = [rng.integers(1, 5, size=n) for n in (30, 12, 50, 8, 40)]
    owners = np.array([3, 1, 2, 0, 4])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    index = fm_index.FMIndex(np.concatenate(parts), starts, owners, 64)
    got = fm_index.matched_windows(index, np.diff(starts), owners, 6)
    grams = [[tuple(p[i : i + 6]) for i in range(len(p) - 5)] for p in parts]
    want = [any(g in grams[o] for o in range(5) if owners[o] < owners[k]) for k, own in enumerate(grams) for g in own]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    hard = spark.createDataFrame([(None, None, None, None, None), (100000, None, "en", "src0", 0), (100001, "", "en", "src1", 0), (100002, "word " * 30000, "en", None, 1)], docs.schema)
    now = docs.unionByName(hard).unionByName(docs.limit(5))
    before = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small)
        now = spark.createDataFrame(now.toPandas(), docs.schema) if name != "mix_sources" else now
        assert now.columns == names, name
        count = now.count()
        assert 0 < count and (name == "mix_sources" or count <= before), name
        before = count
    last = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert last.columns == [*names, "shard"] and last.count() == before


def test_stages_take_empty_tables_and_more_columns(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    empty = spark.createDataFrame([], schema).withColumns({"shard": F.lit(1), "kept": F.lit(2), "n_words": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_shard", "op3_substring_dedup", "op4_quality_rules", "op6_mix_sources", "op10_near_dedup"])
def test_registered_queries_return_every_row(spark, small, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert queries()[name](spark, small).count() == spark.read.parquet(f"{small}/{table}.parquet").count()


def test_written_tables_can_be_cleaned(spark):
    from inkwell.llm import common

    kept = common.written(spark.range(5).toDF("x"))
    path = common.written_paths()[-1]
    assert kept.count() == 5 and path.startswith(common.shared_dir(spark))
    common.clean(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
