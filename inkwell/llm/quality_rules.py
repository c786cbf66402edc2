"""Quality rules by weak supervision: rules vote or abstain, EM learns how far to trust each, and the posterior decides.

Everything on the path over documents is built-in column expressions. The only thing that reaches the driver is
the count of each vote pattern: at most 3 ** len(RULES) rows whatever the input, on which the EM runs.

Defined cases: null or empty text has no words and fails the base rules; null doc_id and repeated rows are judged
row by row; texts of any length are counted whole, in n log n; a table without rows gives no rows (and neutral weights); extra columns
are passed through, and a column that has the name of an added one (the seven that judge() lists, and _q) is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_words, let, table, whole, written

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def repeat_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows whose content is found twice or more among words."""

    def spread(sorted_windows: Column) -> Column:
        twin = F.filter(
            sorted_windows,
            lambda x, i: F.coalesce(F.get(sorted_windows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_windows, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(
            F.sort_array(F.transform(twin, lambda x: x["p"])),
            lambda starts: F.aggregate(
                F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def of(w: Column) -> Column:
        windows = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        )
        return let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), spread)
            ),
        )

    return let(words, of)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column _q of counts a rule may use."""
    t = F.coalesce(F.col(text), F.lit(""))
    line_list = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(line_list, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(
            blank_words(F.col(text)),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("chars"), repeat_words(w).alias("repeat")),
        ).alias("words"),
        F.struct(F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")).cast("long").alias("n"), F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("upper")).alias("letters"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("shouts"),
        F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("stops"),
    )
    return docs.withColumn("_q", counts)


@dataclass(frozen=True)
class Rule:
    """Votes good where good holds, bad where bad holds, and abstains elsewhere."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(F.coalesce(self.bad, F.lit(False)), 0).when(F.coalesce(self.good, F.lit(False)), 1).otherwise(-1)


def default_rules() -> list[Rule]:
    q = lambda *path: F.col(".".join(("_q", *path)))
    n = F.greatest(q("words", "n"), F.lit(1))
    mean_length, symbols, shouts = q("words", "chars") / n, q("n_symbols") / n, q("shouts") / n
    dup_lines = q("lines", "dup") / F.greatest(q("lines", "n"), F.lit(1))
    repeats, upper = q("words", "repeat") / n, q("letters", "upper") / F.greatest(q("letters", "n"), F.lit(1))
    alpha = q("letters", "n") / F.greatest(q("words", "chars"), F.lit(1))
    stops = q("stops") / n
    return [
        Rule("length", q("words", "n") >= 40, q("words", "n") < MIN_WORDS),
        Rule("word_length", mean_length.between(3, 9), ~mean_length.between(2, 14)),
        Rule("symbols", symbols <= 0.05, symbols > 0.25),
        Rule("repeated_lines", dup_lines <= 0.05, dup_lines > 0.35),
        Rule("repeated_words", repeats <= 0.05, repeats > 0.2),
        Rule("capitals", upper <= 0.15, upper > 0.5),
        Rule("shouting", shouts <= 0.05, shouts > 0.3),
        Rule("letters", alpha >= 0.9, alpha < 0.85),
        Rule("sentences", stops.between(0.02, 0.5), ((stops < 0.01) | (stops > 1)) & (q("words", "n") >= 20)),
    ]


#: Bounds of what EM may believe. A rule votes bad on at most FALSE_ALARMS of the good documents and on at least LEAST_FOUND of the bad ones,
#: and a bad document, which fails some rules only, gets a good vote at least GOOD_ANYWAY times as often as a good one.
FALSE_ALARMS, LEAST_FOUND, GOOD_ANYWAY = 0.005, 0.1, 0.5
#: Start, and pseudo-counts of 20 documents each: shares of (bad, abstain, good) votes on good and on bad documents.
START = ((0.005, 0.095, 0.9), (0.3, 0.2, 0.5))


def bounded(shares: tuple[list[float], list[float]]) -> tuple[list[float], list[float]]:
    """Shares of votes on good and bad documents within the bounds, each summing to 1."""
    good, bad = ([x / sum(votes) for x in votes] for votes in shares)
    alarm = min(good[0], FALSE_ALARMS)
    good = [alarm, *(x * (1 - alarm) / (good[1] + good[2]) for x in good[1:])]
    hit = max(bad[0], LEAST_FOUND)
    bad = [hit, *(x * (1 - hit) / (bad[1] + bad[2]) for x in bad[1:])]
    bad = [hit, *(max(b, GOOD_ANYWAY * g * (1 - hit)) for b, g in zip(bad[1:], good[1:], strict=True))]
    return good, [x / sum(bad) for x in bad]


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 60) -> tuple[float, list[tuple[float, float, float]]]:
    """(log-odds of good, for each rule the weights of its bad vote, abstention and good vote) by EM over counted vote patterns.

    patterns: votes (-1 abstains, 0 bad, 1 good) and how many documents have them.
    """
    prior, weights = 0.85, [_weights(*START)] * n_rules
    for _ in range(rounds if patterns else 0):
        base = math.log(prior / (1 - prior))
        seen = [([20 * x for x in START[0]], [20 * x for x in START[1]]) for _ in range(n_rules)]
        good_total = total = 0.0
        for votes, count in patterns:
            odds = base + sum(weights[j][(1, 0, 2)[v + 1]] for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good_total += p * count
            total += count
            for j, v in enumerate(votes):
                seen[j][0][(1, 0, 2)[v + 1]] += p * count
                seen[j][1][(1, 0, 2)[v + 1]] += (1 - p) * count
        prior = (good_total + 8) / (total + 10)
        weights = [_weights(*bounded(x)) for x in seen]
    return math.log(prior / (1 - prior)), weights


def _weights(good: Sequence[float], bad: Sequence[float]) -> tuple[float, float, float]:
    return tuple(math.log(max(g, 1e-6) / max(b, 1e-6)) for g, b in zip(good, bad, strict=True))


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality (posterior) and kept."""
    return judged(features(docs, text), rules, threshold)


def judged(counted: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """As judge, for rows with features already; the rows are read twice."""
    rules = rules or default_rules()
    votes = [r.vote().alias(f"v{j}") for j, r in enumerate(rules)]
    # Bounded by the rules alone: one row for each pattern of votes.
    rows = counted.select(*votes).groupBy(*[f"v{j}" for j in range(len(rules))]).count().collect()
    base, weights = fit(sorted((tuple(r[: len(rules)]), r["count"]) for r in rows), len(rules))
    odds = F.lit(base)
    for rule, (on_bad, on_none, on_good) in zip(rules, weights, strict=True):
        vote = rule.vote()
        odds = odds + F.when(vote == 1, on_good).when(vote == 0, on_bad).otherwise(on_none)
    n, repeat = F.col("_q.words.n"), F.col("_q.words.repeat")
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    return (
        counted.withColumns({"quality": 1 / (1 + F.exp(-odds)), "base_failed": failed, "n_words": n, "word_chars": F.col("_q.words.chars"), "n_symbols": F.col("_q.n_symbols"), "n_dup_lines": F.col("_q.lines.dup"), "n_repeat_words": repeat})
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .drop("_q")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts are written without the texts, so the texts are read once.
    return judged(written(features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with their own columns."""
    wide = docs.select(F.col("text").alias("_text"), whole(docs).alias("_row"))
    # Written with their counts, so that the texts are judged without counting again.
    return judged(written(features(wide, "_text").drop("_text"))).filter("kept").select("_row.*")
