"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that a document belongs to). Token capacity flows from
patterns to source quotas; each further copy of a pattern's documents is an arc of its own that costs more
than the one before (a convex cost of repetition). As only these arcs cost anything, the cheapest flow is found copy by copy: all
that first copies can give, then what second copies can add by rerouting, and so on, each by blocking flows. The flow is solved on
the driver: its size is the number of patterns and sources, not of documents. MAX_PATTERNS bounds it; a corpus with more distinct
sets of sources is refused with an error, nothing is cut, and its sources must be grouped first. A pattern
that takes f words of s gives every document f // s whole copies; the rest goes to documents in seeded
hash order, up to a cut that a histogram of hash buckets finds without sorting a source in one task. What the next
document would overshoot is given to later ones that fit, by further cuts, until the gap is near or nothing fits. Where
all documents that fit are given and words are still missing (the others are longer than that), they are given again, up to the
most copies; what is missing then shows as the difference of target and words taken.

Defined cases: null source is a source of its own, last in order; null or empty text has size 0 and takes nothing; rows that
repeat doc_id and text fall on the same side of the cut; null doc_id is hashed by its text; texts of any length are counted whole;
no rows give no rows; extra columns are kept, and a column called size or copies is replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused, whole, written

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 20240
BUCKETS = 4_096
LAST_HASH = (1 << 62) - 1
#: A gap up to this share of what the pattern gives is left as it is.
NEAR = 0.002
#: Patterns that the driver may hold (README states the solver's seconds at this size).
MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.0, cap: float = MAX_COPIES) -> list[float]:
    """Shares of the total by weight, none above cap times its source's size; what a cap cuts off is reshared by weight."""
    out = [0.0] * len(sizes)
    left, active = share * sum(sizes), list(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def flow(supply: list[int], members: list[list[int]], quotas: list[int], copies: int = MAX_COPIES) -> list[int]:
    """Words that each pattern gives: the greatest flow, and of these the cheapest if copy k of a pattern costs k - 1 a word."""
    free, left = [0] * len(supply), list(quotas)
    given: list[dict[int, int]] = [{} for _ in supply]
    users: list[list[int]] = [[] for _ in quotas]
    for p, sources in enumerate(members):
        for s in sources:
            users[s].append(p)
    for _ in range(copies):
        for p, words in enumerate(supply):
            free[p] += words
        while _blocking_flow(free, left, given, members, users):
            pass
    return [sum(g.values()) for g in given]


def _levels(free: list[int], left: list[int], given: list[dict[int, int]], members: list[list[int]], users: list[list[int]]) -> tuple[list[int], list[int], bool]:
    """How many steps patterns and sources are from a pattern with free words, up to the first sources with room; and whether there is one."""
    of_pattern, of_source = [-1] * len(members), [-1] * len(users)
    now = [p for p, words in enumerate(free) if words > 0 and members[p]]
    for p in now:
        of_pattern[p] = 0
    depth = 0
    while now:
        reached = []
        for p in now:
            for s in members[p]:
                if of_source[s] < 0:
                    of_source[s] = depth + 1
                    reached.append(s)
        if any(left[s] > 0 for s in reached):
            return of_pattern, of_source, True
        depth += 2
        now = []
        for s in reached:
            for p in users[s]:
                if of_pattern[p] < 0 and given[p].get(s, 0) > 0:
                    of_pattern[p] = depth
                    now.append(p)
    return of_pattern, of_source, False


def _blocking_flow(free: list[int], left: list[int], given: list[dict[int, int]], members: list[list[int]], users: list[list[int]]) -> bool:
    """Sends words along shortest ways (pattern, source, another pattern that leaves this source, its other source, ...) until none is left."""
    of_pattern, of_source, some = _levels(free, left, given, members, users)
    if not some:
        return False
    next_source, next_user = [0] * len(members), [0] * len(users)
    for root in range(len(members)):
        while of_pattern[root] == 0 and free[root] > 0:
            way = [root]
            while way:
                at, is_pattern = way[-1], len(way) % 2
                if not is_pattern and left[at] > 0:
                    break
                steps, place = (members[at], next_source) if is_pattern else (users[at], next_user)
                while place[at] < len(steps):
                    to = steps[place[at]]
                    if of_source[to] == of_pattern[at] + 1 if is_pattern else of_pattern[to] == of_source[at] + 1 and given[to].get(at, 0) > 0:
                        break
                    place[at] += 1
                if place[at] < len(steps):
                    way.append(steps[place[at]])
                    continue
                way.pop()
                if way:
                    (next_user if is_pattern else next_source)[way[-1]] += 1
            if not way:
                break
            push = min([free[root], left[way[-1]], *(given[way[k]][way[k - 1]] for k in range(2, len(way), 2))])
            for k in range(0, len(way), 2):
                given[way[k]][way[k + 1]] = given[way[k]].get(way[k + 1], 0) + push
                if k:
                    given[way[k]][way[k - 1]] -= push
            free[root] -= push
            left[way[-1]] -= push
    return True


def plan(docs: DataFrame, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, copies: int = MAX_COPIES) -> tuple[DataFrame, DataFrame]:
    """(pattern, whole, cuts): copies that all documents of a pattern get, and the ranges of hashes (lo, hi] in which documents of up to most words get one more each;
    (source, source_size, target). docs: pattern (JSON list of sources), size, h."""
    spark = docs.sparkSession
    sums = docs.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources; group the sources first")
    sums = sorted((r["pattern"], int(r["size"] or 0)) for r in sums)
    sets = [json.loads(p) for p, _ in sums]
    names = sorted({s for x in sets for s in x}, key=lambda s: (s is None, (s or "").encode("utf-32-be", "surrogatepass")))
    index = {s: i for i, s in enumerate(names)}
    members = [sorted({index[s] for s in x}) for x in sets]
    sizes = [sum(size for (_, size), m in zip(sums, members, strict=True) if i in m) for i in range(len(names))]
    total = sum(size for _, size in sums)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * total / max(1, sum(sizes)), copies)
    got = flow([size for _, size in sums], members, [round(t) for t in goal], copies)

    rows = [(p, f // size if size else 0, f % size if size else 0, size) for (p, size), f in zip(sums, got, strict=True)]
    flows = spark.createDataFrame(rows, "pattern string, whole bigint, rest bigint, size bigint")
    sources = spark.createDataFrame([(s, sizes[i], goal[i]) for i, s in enumerate(names)], "source string, source_size bigint, target double")
    state = flows.select(
        "pattern", "whole", (F.col("whole") * F.col("size") + F.col("rest")).alias("total"), F.col("rest").alias("gap"), F.lit(-1).cast("long").alias("lo"), F.lit(1).alias("turn"),
        F.array().cast("array<struct<lo:bigint,hi:bigint,most:bigint>>").alias("cuts"), (F.col("rest") > 0).alias("open"),
    )
    state = written(state)
    # Every cut passes at least one document, and what it skips is longer than the gap it leaves.
    while not state.filter("open").isEmpty():
        found = state.join(cut(docs, state.filter("open").select("pattern", "lo", "gap")), "pattern", "left")
        piece = F.struct("lo", F.when(F.col("over").isNull(), F.lit(LAST_HASH)).otherwise(F.col("over") - 1).alias("hi"), F.col("gap").alias("most"))
        gap = F.col("gap") - F.coalesce("taken", F.lit(0))
        again = F.col("over").isNull() & (F.col("lo") < 0) & (F.col("taken") > 0) & (F.col("whole") + F.col("turn") < copies)
        state = written(found.select(
            "pattern", "whole", "total", F.when(F.col("open"), gap).otherwise(F.col("gap")).alias("gap"),
            F.coalesce("over", F.lit(-1)).alias("lo"), (F.col("turn") + F.when(again, 1).otherwise(0)).alias("turn"),
            F.when(F.col("open"), F.array_append("cuts", piece)).otherwise(F.col("cuts")).alias("cuts"),
            (F.col("open") & (gap > NEAR * F.col("total")) & (F.col("over").isNotNull() | F.coalesce(again, F.lit(False)))).alias("open"),
        ))
    return state.select("pattern", "whole", "cuts"), sources


def cut(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(pattern, over, taken): the first hash at which the running size of the documents after lo passes the gap (null where all fit), and the words before it.

    state: pattern, lo, gap. Documents above the gap are passed over, or one long text would end a small source's filling early.
    """
    later = docs.join(F.broadcast(state), "pattern").filter((F.col("h") > F.col("lo")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    # The bucket in which the running size passes the gap, then the hash within this bucket alone.
    by_bucket = later.groupBy("pattern", "gap", bucket(F.col("h")).alias("b")).agg(F.sum("size").alias("size"))
    order = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = written(by_bucket.withColumn("upto", F.sum("size").over(order)))
    edge = upto.filter((F.col("upto") > F.col("gap")) & (F.col("upto") - F.col("size") <= F.col("gap"))).select("pattern", "b", (F.col("gap") - F.col("upto") + F.col("size")).alias("room"))
    inside = later.withColumn("b", bucket(F.col("h"))).join(F.broadcast(edge), ["pattern", "b"]).groupBy("pattern", "room", "h").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("pattern").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = inside.withColumn("upto", F.sum("size").over(order))
    fits = F.col("upto") <= F.col("room")
    ends = summed.groupBy("pattern", "room").agg(F.min(F.when(~fits, F.col("h"))).alias("over"), F.max(F.when(fits, F.col("upto"))).alias("in"))
    whole = upto.groupBy("pattern", "gap").agg(F.max("upto").alias("all"))
    return whole.join(ends, "pattern", "left").select("pattern", "over", F.when(F.col("over").isNull(), F.col("all")).otherwise(F.col("gap") - F.col("room") + F.coalesce("in", F.lit(0))).alias("taken"))


def bucket(h: Column) -> Column:
    return F.floor(h / F.lit((1 << 62) // BUCKETS)).cast("long")


def sized(docs: DataFrame, sources: Column, text: str = "text", id_col: str = "doc_id", seed: int = SEED) -> tuple[DataFrame, str, str]:
    """docs with size, and the names of two added columns: the row's set of sources and its seeded hash."""
    pattern, h = unused(docs, "_pattern", "_h")
    names = F.when(sources.isNull() | (F.size(sources) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(sources)))
    return docs.withColumns({
        "size": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"),
        pattern: F.to_json(names),
        h: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)), 2),
    }), pattern, h


def mixed(counted: DataFrame, pattern: str, h: str, **options) -> tuple[DataFrame, DataFrame]:
    """The rows of sized() with copies instead of its two columns, and the table of (source, source_size, target)."""
    slim = written(counted.select(F.col(pattern).alias("pattern"), "size", F.col(h).alias("h")))
    flows, by_source = plan(slim, **options)
    (f,) = unused(counted, "_f")
    # As many rows as there are sets of sources, of which there are at most MAX_PATTERNS.
    out = counted.drop("copies").join(F.broadcast(flows.select(F.col("pattern").alias(pattern), F.struct("whole", "cuts").alias(f))), pattern, "left")
    more = F.size(F.filter(F.col(f)["cuts"], lambda c: (F.col(h) > c.lo) & (F.col(h) <= c.hi) & (F.col("size") <= c.most)))
    return out.withColumn("copies", F.col(f)["whole"] + more.cast("long")).drop(pattern, h, f), by_source


def mix(docs: DataFrame, sources: Column, text: str = "text", id_col: str = "doc_id", seed: int = SEED, **options) -> tuple[DataFrame, DataFrame]:
    """docs with size and copies, and the table of (source, source_size, target). sources: an array of each row's sources."""
    return mixed(*sized(docs, sources, text, id_col, seed), **options)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted, pattern, h = sized(docs, F.array("source"))
    # The sizes are written without the texts, so the texts are read once.
    out, by_source = mixed(written(counted.drop("text")), pattern, h)
    by_source = by_source.select(F.col("source").alias("_s"), "source_size", "target")
    return out.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the chosen documents, each as often as the mix takes it, with their own columns."""
    row = whole(docs).alias("_row")
    wide = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.array("source").alias("_sources"), row)
    out, _ = mix(wide, F.col("_sources"), "_text", "_id")
    return out.filter("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"), "_row").select("_row.*")
