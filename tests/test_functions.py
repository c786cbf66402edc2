"""Functions and rules on literals."""

import hashlib

import numpy as np
import pytest
from inkwell.functions import text as tx
from inkwell.functions import vectors
from inkwell.operators import analytics, governance, search
from inkwell.operators.documents import near_pairs, sliding
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_terms_have_cjk_bigrams_and_keep_order(spark):
    assert one(spark, tx.terms(F.col("t")), t="差旅审批 Policy policy 审批") == ["差旅审批", "差旅", "旅审", "审批", "policy"]
    assert one(spark, tx.terms(F.col("t")), t="!?") == ["!?"]


def test_fingerprint_ignores_case_and_blanks(spark):
    a, b = (one(spark, tx.fingerprint(F.col("t")), t=t) for t in (" A  b\n\tC ", "a B c"))
    assert a == b == hashlib.sha256(b"a b c").hexdigest()[:24]


def test_error_signature(spark):
    assert one(spark, tx.error_signature(F.col("t")), t="Failed at  0x deadbeef01 after 120 s") == "failed at 0x <hex> after <num> s"
    assert one(spark, tx.error_signature(F.lit(None).cast("string"))) == "unknown"


def test_token_counts(spark):
    assert one(spark, tx.tokens_by_length(F.col("t")), t="abcde") == 2 and one(spark, tx.tokens_by_length(F.col("t")), t="") == 1
    assert one(spark, tx.tokens_for_usage(F.col("t")), t="two words") == 2 and one(spark, tx.tokens_for_usage(F.col("t")), t="oneword") == 3
    assert one(spark, tx.tokens_by_units(F.col("t")), t="员工报销流程") == 3


def test_sentences_keep_their_ends(spark):
    assert one(spark, tx.sentences(F.col("t")), t="第一条：提交申请。第二条：经理审批！第三条：完成报销？") == ["第一条：提交申请。", "第二条：经理审批！", "第三条：完成报销？"]


def test_text_fits_bytes(spark):
    text = "预算说明" * 400
    got = one(spark, tx.fits_bytes(F.col("t"), 2048), t=text)
    assert text.startswith(got) and 2045 <= len(got.encode()) <= 2048
    assert one(spark, tx.fits_bytes(F.col("t"), 2048), t="short") == "short"


def test_simhash_equals_votes(spark):
    words = ["alpha", "beta", "beta", "gamma"]
    votes = [sum(1 if int(hashlib.md5(w.encode()).hexdigest(), 16) >> i & 1 else -1 for w in words) for i in range(64)]
    want = sum(1 << i for i in range(64) if votes[i] > 0)
    got = tx.majority_bits(np.array([tx.term_hash(w) for w in words], dtype=np.uint64).view(np.int64))
    assert got & (1 << 64) - 1 == want and tx.majority_bits([]) == tx.majority_bits(None) == 0


def test_near_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, b ^ sum(1 << rng.randrange(63) for _ in range(i % 5))) for i, b in enumerate(base)]
    hashes = {h for _, h in rows}
    want = {(g, h, (g ^ h).bit_count()) for g in hashes for h in hashes if g < h and (g ^ h).bit_count() <= 3}
    got = {tuple(r) for r in near_pairs(spark.createDataFrame([(h,) for h in hashes], "h bigint")).collect()}
    assert got == want and len(want) > 5


def test_hidden_marks_survive_leading_zeros(spark):
    for code in ("0000000000000abc", "fedcba9876543210"):
        marked = tx.mark_hidden(F.lit(code))
        assert one(spark, tx.mark_read(F.concat(F.lit("text "), marked))) == code
    assert one(spark, tx.mark_read(F.lit("plain"))) is None


def test_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")
    assert one(spark, vectors.cosine_of_shared(arr(1, 2, 9), arr(1, 2))) == pytest.approx(1.0)
    assert one(spark, vectors.cosine_of_shared(arr(0, 0), arr(3, 4))) == 0.0 and one(spark, vectors.cosine_of_shared(arr(), arr(1))) == 0.0
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, vectors.cosine(a, a)) == pytest.approx(1.0) and one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    got = one(spark, vectors.hash_embedding(F.array(F.lit("x"), F.lit("y"))))
    raw = [sum(hashlib.sha256(w.encode()).digest()[i % 32] / 255 for w in ("x", "y")) for i in range(64)]
    norm = sum(v * v for v in raw) ** 0.5
    assert got == pytest.approx([round(v / norm, 6) for v in raw], abs=1e-6)
    left, right = F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.2)), F.create_map(F.lit("b"), F.lit(0.1), F.lit("c"), F.lit(1.0))
    assert one(spark, vectors.sparse_overlap(left, right)) == pytest.approx(0.1)
    assert one(spark, vectors.resized(a, 4)) == [1.0, 2.0, 0.0, 0.0] and one(spark, vectors.resized(a, 1)) == [1.0]


@pytest.mark.parametrize("n,size,stride", [(0, 4, 3), (3, 4, 3), (4, 4, 3), (5, 4, 3), (20, 4, 3), (21, 6, 1)])
def test_sliding_windows(spark, n, size, stride):
    words, want, at = [str(i) for i in range(n)], [], 0
    while words:
        want.append(words[at : at + size])
        if at + size >= n:
            break
        at += stride
    assert one(spark, sliding(F.split(F.lit(" ".join(words)), " ") if n else F.array().cast("array<string>"), size, stride)) == want


def test_p95_by_both_definitions(spark):
    for values, first, second in (([10, 20, 30, 40, 100], 40, 40), ([*range(1, 9), 100, 120], 100, 100), ([7], 7, 7)):
        rows = spark.createDataFrame([("k", float(v)) for v in values], "key string, value double")
        assert analytics.nearest_place(rows, ["key"], "value", F.floor(0.95 * (F.col("n") - 1))).first()["value"] == first
        if len(values) == 10:
            assert analytics.nearest_place(rows, ["key"], "value", F.greatest(F.floor(F.col("n") * 0.95) - 1, F.lit(0))).first()["value"] == second


def test_synthetic_titles(spark):
    names = ["push-test.csv", "tmp_ui_upload.csv", "smoke_1.csv", "smoke.csv", "loadtest_4.csv", "perf_0.csv", "large.csv", "差旅审批制度.csv"]
    rows = spark.createDataFrame([(n,) for n in names], "t string").select("t", search.synthetic_title(F.col("t")).alias("x"))
    assert [r["t"] for r in rows.collect() if not r["x"]] == ["差旅审批制度.csv"]


def test_permissions(spark):
    docs = spark.createDataFrame([(1, "t", 1, "hr"), (2, "t", 3, "public"), (3, "t", 1, "public"), (4, "u", 1, "hr"), (5, "t", 2, "legal")], "doc_id int, tenant_id string, access_level int, department string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(search.secure(docs, "t", "ADMIN")) == [1, 2, 3, 5] and ids(search.secure(docs, "t", "EMPLOYEE", "hr")) == [1, 3] and ids(search.secure(docs, "t", "MANAGER")) == [1, 2, 3, 5]


def test_pii_round_trip(spark):
    texts = ["联系电话13800138000，补贴5000元。", "姓名：张三 邮箱 a.b@example.com 卡 6222020200112233445 住址：北京市海淀区中关村大街1号", "none", "", None, "13800138000 and 13900139000"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in governance.mask_pii(docs).withColumn("back", governance.restore_pii(F.col("masked"), F.col("found"))).collect()}
    assert out[0]["masked"] == "联系电话[PHONE_1]，补贴[MONEY_1]。" and out[5]["masked"] == "[PHONE_2] and [PHONE_1]"
    assert all(x in out[1]["masked"] for x in ("[NAME_1]", "[EMAIL_1]", "[BANK_1]", "[ADDRESS_1]"))
    assert [out[i]["back"] for i in range(6)] == texts


def test_department_and_freshness(spark):
    ask = F.lit("How do I get an expense invoice 报销?")
    assert one(spark, search.asked_departments(ask)) == ["finance"] and one(spark, search.asked_departments(F.lit("nothing"))) == []
    as_of = F.lit("2026-01-31").cast("date")
    for date, want in (("2026-01-10", 0.6), ("2099-01-01", 0.6), ("2025-09-01", 0.3), ("2025-03-01", 0.1), ("2020-01-01", 0.0), ("not a date", 0.0), (None, 0.0)):
        assert one(spark, search.freshness(F.lit(date).cast("string"), as_of)) == want, date
    hits = [one(spark, search.department_and_freshness(F.lit(d), F.lit("2026-01-30"), ask, as_of)) for d in ("finance", "hr")]
    assert hits == [1.6, 0.6]
