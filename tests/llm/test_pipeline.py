"""The pipeline from end to end against plain Python, row by row; of the mix, which ties between documents leave open, the rules that it must keep."""

import struct
from collections import Counter

import corpus_pipeline
import xxhash
from inkwell.llm import mixing, sharding

from tests.llm import samples
from tests.llm.test_text_operators import components_by_brute_force, contamination_by_brute_force, quality_in_plain_python


def test_pipeline_equals_plain_python(spark, small):
    rows = {r["doc_id"]: tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]

    good = {d for d, (c, p) in quality_in_plain_python(rows.values()).items() if not c[5] and p >= 0.5}
    first = {d for d, _, c in components_by_brute_force([rows[d] for d in sorted(good)], 5, 80) if d == c}
    clean = {d for d, _, _, _, hit in contamination_by_brute_force([rows[d] for d in first], items) if not hit}
    assert len(rows) > len(good) > len(first) > len(clean) > 20

    out = [tuple(r) for r in corpus_pipeline.run(spark, small).select("doc_id", "text", "source", "shard").collect()]
    copies = Counter(r[0] for r in out)
    assert set(copies) <= clean and all(r[:3] == rows[r[0]] for r in out) and max(copies.values()) <= 3

    # Each source's words come near its target: no nearer than the longest of its documents lets them.
    size = {d: len(samples.WORD.findall(rows[d][1] or "")) for d in clean}
    sources = sorted({rows[d][2] for d in clean})
    sizes = [sum(size[d] for d in clean if rows[d][2] == s) for s in sources]
    targets = mixing.targets(sizes, [1 + i % 3 for i in range(len(sources))])
    for s, target in zip(sources, targets, strict=True):
        own = [d for d in clean if rows[d][2] == s]
        assert abs(sum(size[d] * copies[d] for d in own) - target) <= max(size[d] for d in own), s

    owner = sharding.fill([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    start = xxhash.xxh64_intdigest(struct.pack("<i", sharding.SEED), seed=42)
    for doc_id, _, _, shard in out:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=start)
        assert shard == owner[(h - (1 << 64) if h >> 63 else h) % sharding.SLOTS]
