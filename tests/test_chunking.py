"""Folds along one document's pieces."""

import numpy as np
from inkwell.operators import chunking
from pyspark.sql import functions as F


def test_segments_break_at_headings_pages_and_budget():
    body = "This line is body text that ends with a full stop and is long enough."
    assert chunking.segments(["Heading", body, body, "Next heading", body]) == [(0, 3, -(-(7 + 2 * len(body) + 2) // 4)), (3, 2, -(-(12 + len(body) + 1) // 4))]
    assert [x[:2] for x in chunking.segments([body] * 5, page=2)] == [(0, 2), (2, 2), (4, 1)]
    assert [x[:2] for x in chunking.segments([body] * 4, most=len(body) // 4 + 1)] == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert chunking.segments([]) == []


def test_packs_stay_under_the_limit_and_short_ones_go():
    assert chunking.packed(["a" * 100] * 5, most=210, least=150) == [(0, 2, 202), (2, 2, 202)]
    assert chunking.packed(["short"], least=180) == [(0, 1, 5)] and chunking.packed([]) == []


def test_groups_break_where_neighbours_differ_and_keep_a_tail():
    like = ["the cat sat here", "the cat sat there", "the cat sat here"]
    assert chunking.grouped(like, least=0.5) == [(0, 3, 12)]
    assert [x[:2] for x in chunking.grouped(["a b"] * 4, most=4)] == [(0, 2), (1, 2), (2, 2)]  # one sentence is a tail of 0.6 words at least
    assert [x[:2] for x in chunking.grouped(["a b"] * 6, most=8, overlap=0.5)] == [(0, 4), (2, 4)]
    assert [x[:2] for x in chunking.grouped(["one", "two", "three"], least=1.1, overlap=0.001)] == [(0, 1), (0, 2), (1, 2)]
    assert chunking.grouped([]) == [] and chunking.grouped(["", "x"])[-1][2] == 1


def test_sentence_vectors_equal_the_column_form(spark):
    from inkwell.functions import vectors

    row = spark.range(1).select(vectors.hash_embedding(F.array(F.lit("cat"), F.lit("报销"))).alias("v")).first()["v"]
    own = chunking.sentence_vector("Cat, 报销!")
    assert np.allclose(row, own / np.sqrt(own @ own), atol=1e-6)


def test_every_piece_is_in_one_part(spark, small):
    lines = chunking.lines(spark, small).select("doc_id", F.size("pieces").alias("all"))
    parts = chunking.parent_segments(spark, small).groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    assert parts.join(lines, "doc_id").filter("n <> all OR first <> 0").count() == 0 and parts.count() == lines.filter("all > 0").count()
