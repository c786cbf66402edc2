"""Small tables with the hard cases: nulls, empty and long texts, repeated rows and ids, columns with clashing names."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(seed: int = 1, n: int = 60, size: int = 400) -> list[tuple]:
    """(doc_id, text, source): random texts, exact and near copies, shared passages, and the hard cases."""
    rng = random.Random(seed)
    passage = words(rng, 70, size)
    rows = []
    for i in range(n):
        body = words(rng, rng.choice((0, 1, 2, 5, 12, 60, 120, 300)), size)
        if i % 5 == 1 and rows:
            body = rows[rng.randrange(len(rows))][1].split()
            if i % 2 and len(body) > 20:
                body[rng.randrange(len(body))] = "changed"
        if i % 7 == 2:
            at = rng.randrange(len(body) + 1)
            body = body[:at] + passage + body[at:]
        rows.append((100 - i, rng.choice((" ", "\n", " \t ", "\r\n")).join(body), f"src{i % 4}" if i % 9 else None))
    rows += [(200, None, "src1"), (201, "", "src2"), (202, "   \n\t ", None), (203, "É\u00a0x\u3000y Ünï \U0001d54f", "src3"), (None, rows[3][1], "src0"), (None, None, None)]
    rows += [(204, " ".join(words(rng, 6000, size)), "src0"), (205, "x" * 70000, "src0"), rows[10], rows[11], (204, " ".join(words(rng, 80, size)), "src1")]
    return rows


def frame(spark, rows: list[tuple], schema: str = "doc_id bigint, text string, source string"):
    """The rows over several partitions, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    extra = {"kept": F.lit("own"), "n_words": F.lit(-5), "size": F.lit("big"), "shard": F.lit(9), "items": F.lit("i"), "h": F.lit(1.5), "quality": F.lit("q"), "rest": F.lit(0)}
    return spark.createDataFrame(rows, schema).repartition(3).withColumns(extra)


def shingles(text: str | None, size: int) -> frozenset:
    ws = WORD.findall((text or "").translate(FOLD))
    if len(ws) < size:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
