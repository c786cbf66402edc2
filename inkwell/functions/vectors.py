"""Dense and sparse vectors as arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

HASH_DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is empty or has no length."""
    return let(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), lambda norm: F.when(F.coalesce(norm, F.lit(0.0)) == 0, 0.0).otherwise(dot(a, b) / norm))


def cosine_of_shared(a: Column, b: Column) -> Column:
    """Over the entries that both vectors have; a vector without length counts as having length 1, an empty one gives 0."""
    n = F.least(F.size(a), F.size(b))
    length = lambda v: let(F.sqrt(dot(v, v)), lambda x: F.when(x == 0, 1.0).otherwise(x))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(let(F.slice(a, 1, n), lambda x: let(F.slice(b, 1, n), lambda y: dot(x, y) / (length(x) * length(y)))))


def hash_embedding(words: Column) -> Column:
    """64 dimensions: bytes of the words' SHA-256 sums over 255, twice in a row, summed and scaled to length 1."""
    digests = F.transform(words, lambda w: F.sha2(w, 256))
    part = lambda h, i: F.conv(F.substr(h, F.lit(2) * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255
    raw = let(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(HASH_DIM - 1)), lambda i: F.aggregate(d, F.lit(0.0), lambda acc, h: acc + part(h, i))))
    return let(raw, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(F.round(x / n, 6)))))


def sparse_overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller weights of shared keys."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(shared, F.lit(0.0), lambda acc, k: acc + F.least(F.element_at(a, k), F.element_at(b, k)))


def resized(v: Column, dim: int) -> Column:
    """Cut or padded with zeros to dim entries."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


#: Vectors that one task holds of the queries and of the searched rows.
BLOCK, CHUNK = 1_024, 4_096
