"""Spelling variants, collocations and personal data, against plain Python on small tables with the hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from inkwell.llm import collocations, personal_data, spelling_variants
from pyspark.sql import functions as F

from tests.llm import samples

def clashing():
    return {"word": F.lit("w"), "N": F.lit(1), "kind": F.lit("k"), "a.b": F.lit(2.5), "m": F.create_map(F.lit("x"), F.lit(1)), "Lang": F.lit("own"), "_t": F.lit(0), "_base": F.lit(0)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs, min_chars, min_count, every, ratio):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(samples.FOLD)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    found, out = {w: [x for x in n if near(w, x)] for w in n}, []
    form = {w: (best if (best := min(x, key=lambda v: (-n[v], v))) and n[best] >= ratio * n[w] else None) if (x := found[w]) else None for w in n}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def word_docs(seed, n, letters):
    """Families of words one edit apart, of lengths up to 30, with skewed counts and the hard cases."""
    rng = random.Random(seed)
    heads = ["".join(rng.choice(letters) for _ in range(rng.choice((7, 7, 8, 9, 12, 30)))) for _ in range(25)]
    docs = []
    for i in range(n):
        out = []
        for _ in range(60):
            w = heads[min(int(rng.expovariate(0.3)), 24)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
            out.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice((" ", "\n", "1", "ł")).join(out)))
    return [*docs, (None, docs[0][1]), (5, None), (6, ""), docs[1], docs[1], (2**60, docs[2][1]), (9, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 2999 + " " + "a" * 2999), (10, "\U0001d54f×÷×÷×÷× " * 3)]


@pytest.mark.parametrize(("letters", "limit", "every", "ratio"), [("ab", 4, 31, 10), ("abcéß", 1024, 7, 3), ("abcdefgh", 2, 5, 2)])
def test_spelling_variants(spark, letters, limit, every, ratio):
    docs = word_docs(3, 40, letters)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).withColumns(clashing())
    want = variants(docs, 7, 2, every, ratio)
    assert rows_of(spelling_variants.spelling_variants(df, every=every, ratio=ratio, limit=limit)) == want
    assert sum(w[1] is not None for w in want) > 3 and sum(w[4] > 1 for w in want) > 20


def test_spelling_variants_of_tiles_and_chunks(spark, monkeypatch):
    """Blocks over several tiles and chunks that end inside a block."""
    for name, value in (("TILE", 8), ("CHUNK_ROWS", 50)):
        monkeypatch.setattr(spelling_variants, name, value)
    docs = word_docs(4, 30, "ab")
    words = spelling_variants.counted_words(spark.createDataFrame(docs, "doc_id bigint, text string"))
    rows = spelling_variants.blocks(words).select("block", "m", "lo", "hi", "cap", "word", "n").orderBy("m", "block").toArrow()
    found = Counter()
    for out in spelling_variants.compare(iter(rows.to_batches(max_chunksize=7))):
        for w, c in zip(out["word"].to_pylist(), out["n_near"].to_pylist(), strict=True):
            found[w] += c
    assert {w: c for w, c in found.items() if c} == {w: k for w, _, _, _, k, _ in variants(docs, 7, 2, 31, 10) if k}


def test_spelling_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants.spelling_variants(empty).count() == 0
    assert rows_of(spelling_variants.spelling_variants(spark.createDataFrame([(1, "Letters"), (2, "letters")], "doc_id bigint, text string"))) == [("letters", None, "letters", 2, 0, None)]


# Collocations


def phrases(docs, min_count, top):
    n, f, out = Counter(), defaultdict(Counter), []
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(samples.FOLD)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        closed = {x for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and counts[x := p[i:j]] == a}
        kept = []
        for p, a in found.items():
            if p not in closed:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=repr)


def phrase_docs(seed):
    rng = random.Random(seed)
    fixed = [[f"x{i}{j}" for j in range(rng.randrange(2, 9))] for i in range(12)]
    docs = []
    for _ in range(160):
        ws = []
        for _ in range(rng.choice((0, 3, 40))):
            ws += rng.choice(fixed) if rng.random() < 0.4 else [f"W{min(int(rng.expovariate(0.08)), 90)}" for _ in range(3)]
            ws[-1] += rng.choice(("", "", ",", ".\n", " \t", "?!", "é", "\U0001d54f"))
        docs.append((rng.choice((" ", "  ", "\t")).join(ws), rng.choice(("en", "en", "en", "de", None, ""))))
    return [*docs, (None, "en"), ("", None), docs[0], docs[0], ("long " * 3000, "de"), (". " * 2000, "en"), ("only", "fr")]


@pytest.mark.parametrize(("min_count", "top", "growth", "bits"), [(5, 2000, 16, 1 << 20), (4, 12, 2, 1 << 20), (3, 20, 2, 64)])
def test_collocations(spark, min_count, top, growth, bits):
    """Also with a bit table that says yes to nearly every word."""
    docs = phrase_docs(2)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4).withColumns({k: v for k, v in clashing().items() if k != "Lang"})
    want = phrases(docs, min_count, top)
    assert rows_of(collocations.collocations(df, min_count=min_count, top=top, growth=growth, bits=bits)) == want and len(want) > 30


def test_collocations_of_parts(spark):
    """Texts cut at piece ends into small parts give the same words."""
    import pyarrow as pa

    texts = [t for t, _ in phrase_docs(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    whole, cut = ([(h.tolist(), r.tolist()) for _, h, _, _, r in collocations._parts(batch, step)] for step in (1 << 30, 50))
    assert len(cut) > 100 and sum((h for h, _ in cut), []) == whole[0][0] and sum((r for _, r in cut), []) == whole[0][1]


def test_collocations_are_exact_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", 1, "p", 4 * 10**12), ("en", 2, "q", 5 * 10**12)], "lang string, h long, word string, f long")
    pairs = spark.createDataFrame([([1, 2], 3 * 10**12 + 1)], "w array<long>, f long")
    totals = spark.createDataFrame([("en", 9 * 10**14 + 7)], "lang string, n long")
    assert collocations.scored(pairs, words, totals, 10**13).first()["score"] == 1000 * (3 * 10**12 + 1) * (9 * 10**14 + 7) // (4 * 10**12 * 5 * 10**12)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_of(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                value = m[0].translate(samples.FOLD) if kind == "email" else ".".join(str(int(x)) for x in m[0].split(".")) if kind == "ip" else digits
                out.append((m.start(), rank, m.end(), kind, value, m))
    return sorted(out, key=lambda s: s[:3])


def all_spans(docs, context, least, remove, generalise):
    term = re.compile(r"[^\W\d_]{3,}")
    texts = {t or "" for _, t in docs}
    with_value, with_pair, with_term, facts = defaultdict(set), defaultdict(set), defaultdict(set), set()
    for text in texts:
        for w in term.findall(text.translate(samples.FOLD)):
            with_term[w].add(text)
        for kind, pattern in BASE.items():
            hits = [m for m in re.finditer(pattern, text) if kind != "card" or len(re.sub("[^0-9]", "", m[0])) > 11]
            good = {s[5].span(): s[4] for s in base_of(text) if s[3] == kind}
            for i, m in enumerate(hits):
                if m.span() in good:
                    gap = text[hits[i - 1].end() if i else 0 : m.start()], text[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(text)]
                    key = kind, good[m.span()]
                    with_value[key].add(text)
                    for w in term.findall(gap[0].translate(samples.FOLD))[-context:] + term.findall(gap[1].translate(samples.FOLD))[:context]:
                        with_pair[key, w].add(text)
                        facts.add((text, key, w))
    told = defaultdict(dict)
    for text, key, w in facts:
        n, v, vt, t = len(texts), len(with_value[key]), len(with_pair[key, w]), len(with_term[w])
        if v >= least and vt >= least and v < n and (share := math.log2(n * vt / (v * t)) / math.log2(n / v)) >= generalise:
            told[text][w] = max(share, told[text].get(w, 0))
    out = []
    for doc_id, text in docs:
        base = base_of(text)
        spans = [(s, r, e, k) for s, r, e, k, *_ in base]
        for m in term.finditer((text or "").translate(samples.FOLD)):
            share = told[text or ""].get(m[0])
            if share and not any(s < m.end() and e > m.start() for s, _, e, _ in spans[: len(base)]):
                spans.append((m.start(), 4, m.end(), "removed") if share >= remove else (m.start(), 5, m.end(), "generalised"))
        said = lambda ss: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(ss))
        kinds = Counter(s[3] for s in base)
        out.append((doc_id, *(kinds[k] for k in BASE), hashlib.sha256(said(spans[: len(base)]).encode()).hexdigest(), said(spans)))
    return sorted(out, key=repr)


def personal_docs(seed):
    rng = random.Random(seed)
    values = ["ann.b@mail.example.org", "10.0.0.255", "4111 1111 1111 1111", "+49 (30) 1234-567", "A.B@c-d.e.f", "5500-0000-0000-0004"]
    odd = ["a@b", "x@y.z.", "a@b.c_d@e.f.g@h.i", "..@-.-", "256.1.1.1", "1.2.3.4.5.6.7.8", "00010.1.1.0255", "99999999999999999999.1.1.1", "4111111111111112", "1" * 20, "1  2", "+1 ((((", "+1+2 3 4 5 6 7 8 9 0", "+123456789012345678", "++1234567890", "١٢@٣.x", "1.1.1.1@a.b 4111-1111 1111-1111"]
    docs = []
    for i in range(90):
        ws = [f"{rng.choice('abcdefgh')}{rng.choice('klmno')}{rng.choice('stuvw')}" for _ in range(rng.choice((0, 5, 30)))]
        if i % 3 == 0:
            v = rng.randrange(len(values))
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = [rng.choice((f"Quux{'xyzuvw'[v]}", "mid", "\U0001d54féèê")), values[v], f"holder{'pqrstu'[v] * 3}" if rng.random() < 0.8 else "none"]
        if i % 4 == 0:
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(odd))
        if i % 10 == 1:
            ws.append(f"Quux{'xyzuvw'[rng.randrange(6)]}")
        docs.append((i, rng.choice((" ", "\n", ", ", "é ")).join(ws)))
    return [*docs, (None, docs[0][1]), (5, None), (6, ""), docs[3], docs[3], (7, "x" * 700), (8, "1" * 700), (9, "1 " * 300), (10, "a@b.c " * 100), (11, "a." * 300), (12, "+1" * 200), (13, "a@" * 200), (14, "1." * 200)]


def test_personal_data(spark):
    docs = personal_docs(1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).withColumns(clashing() | {"spans": F.lit("own"), "Sanitised": F.lit(0)})
    out = personal_data.sanitise(df, remove=0.75, generalise=0.55)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == list(BASE).index(k)))
    found = rows_of(out.select("doc_id", *map(count, BASE), F.sha2(personal_data.listed(F.col("base")), 256), personal_data.listed(F.col("spans"))))
    want = all_spans(docs, 10, 3, 0.75, 0.55)
    assert found == want
    assert sum("removed" in r[-1] for r in want) > 5 and sum("generalised" in r[-1] for r in want) > 3 and sum(bool(r[-1]) for r in want) < len(want)
    assert all(r["spans"] or r["sanitised"] == (r["text"] or "") for r in out.select("spans", "sanitised", "text").collect())
    assert {"word", "a.b", "m", "_t", "_base"} <= set(out.columns)


def test_sanitised_text(spark):
    docs = [(1, "Call +49 30 1234567 or mail me@here.org, 10.1.2.3."), (2, "nothing here"), (3, None)]
    out = personal_data.sanitise(spark.createDataFrame(docs, "doc_id bigint, text string")).select("doc_id", "sanitised")
    assert dict(map(tuple, out.collect())) == {1: "Call [phone] or mail [email], [ip].", 2: "nothing here", 3: ""}


def test_personal_data_of_nothing(spark):
    assert personal_data.sanitise(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_texts_without_a_match_take_linear_time(spark):
    texts = ["x" * 200_000, "1" * 200_000, "1 " * 100_000, "a." * 100_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000, "+1" + "(" * 100_000]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(F.size(F.filter(personal_data.base_spans(F.col("text")), lambda s: s["kind"] != 1)).alias("n")).collect()
    assert [r["n"] for r in found] == [0] * len(texts)


def test_many_matches_in_one_text(spark):
    text = "é a@b.c" * 1500
    found = spark.createDataFrame([(text,)], "text string").select(personal_data.base_spans(F.col("text")).alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer(BASE["email"], text)]
