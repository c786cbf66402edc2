"""URL filters: explicit rules first, then trust and distrust propagated over the host graph.

Rules (host, path) fit a host and its subdomains; the longest fitting rule decides. For pages without a rule, hosts
are scored by personalised PageRank: trust flows along links from hosts whose pages rules allow, distrust flows
against links from hosts whose pages rules block (a host that links to bad hosts is suspect). A host is blocked when
its distrust exceeds RATIO times its trust. Links inside a host carry no evidence and are left out.

The graph is aggregated to one row for each pair of hosts before any iteration; every round is one join and one
aggregation with partial sums, and lineage is cut in the shared folder. Rounds end when the scores change by at most TOLERANCE
of the seeds' mass, and scores are compared at that precision: a host whose distrust is below it has no evidence against it.
The links of a host with more than HUB_LINKS neighbours are dealt to several keys, to which its score is copied.

Defined cases: null url, or one without "://", has empty host and path, fits no rule and is allowed; null or empty
html has no links; very long html is searched whole; repeated rows are judged row by row; no rows give no rows; extra columns
take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table, written

#: (verdict, host, path): the rules that the query judges by. Fixed values.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"))
DAMPING = 0.85
#: Change of all scores together, as a share of the seeds' mass, at which the rounds end (85 rounds at most at this damping).
TOLERANCE = 1e-6
#: Rounds after which the change is measured and lineage is cut.
STRIDE = 4
#: Neighbours that one key of the links' table may have.
HUB_LINKS = 50_000
RATIO = 1.0
#: Blocked hosts up to which their list is broadcast to the pages (under 100 bytes each).
BROADCAST_ROWS = 100_000
HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the last one that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts; pages: host, html. weight: the share of src's links."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("link"))
    edges = links.select("src", url_host(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    return edges.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def shares(edges: DataFrame, kind: str) -> DataFrame:
    """(kind, src, salt, salts, dst, w): edges with each weight divided by the sum over src; a hub's are dealt to salts keys."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / F.lit(HUB_LINKS)).cast("int").alias("salts"))
    return edges.join(out, "src").select(F.lit(kind).alias("kind"), "src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "salts", "dst", (F.col("n") / F.col("all")).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score) by personalised PageRank; edges: as shares() gives; seeds: kind, host, mass."""
    start = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"))
    mass = seeds.agg(F.sum("mass")).first()[0] or 0.0
    hubs = edges.filter("salts > 1").groupBy("kind", F.col("src").alias("host")).agg(F.first("salts").alias("salts"))
    many = not hubs.isEmpty()
    ranks, change = seeds.select("kind", "host", F.col("mass").alias("score")), mass
    while change > tolerance * mass:
        for k in range(STRIDE):
            before = ranks
            spread = ranks.join(hubs, ["kind", "host"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts") if many else ranks.withColumn("salt", F.lit(0))
            moved = edges.join(spread.withColumnRenamed("host", "src"), ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
            ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if k == STRIDE - 2:
                ranks = written(ranks)
        ranks = written(ranks)
        both = ranks.unionByName(before.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("change"))
        change = both.agg(F.sum("change")).first()[0] or 0.0
    return ranks


def blocked_hosts(judged: DataFrame, tolerance: float = TOLERANCE, ratio: float = RATIO) -> DataFrame:
    """(host) that the propagated scores block; judged: host, html, by_rule."""
    hosts = judged.filter(F.col("by_rule").isNotNull()).groupBy("host").agg(*[F.sum((F.col("by_rule") == v).cast("double")).alias(v) for v in ("allow", "block")])
    seeds = written(
        hosts.select("host", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col(v) / (F.col("allow") + F.col("block"))).alias("mass")) for kind, v in (("trust", "allow"), ("distrust", "block"))])).alias("s"))
        .select("s.kind", "host", "s.mass").filter("mass > 0")
    )
    pairs = written(host_edges(judged))
    both = written(shares(pairs, "trust").unionByName(shares(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), "distrust")))
    # Without links the seeds' own scores decide.
    ranks = seeds.withColumnRenamed("mass", "score") if both.isEmpty() else propagate(both, seeds, tolerance)
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return ranks.groupBy("host").agg(score("trust").alias("t"), score("distrust").alias("d")).filter(F.col("d") - ratio * F.col("t") > tolerance).select("host")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of each row; pages: page_id, url, html."""
    named = pages.select("page_id", "html", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": rule, "by_rule": verdict})
    blocked = written(blocked_hosts(judged.select("host", "html", "by_rule"), tolerance)).withColumn("bad", F.lit(True))
    small = blocked.count() <= BROADCAST_ROWS
    out = judged.drop("html").join(F.broadcast(blocked) if small else blocked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _oracle() -> str:
    rules = ", ".join(f"('{says}', '{h}', '{p}')" for says, h, p in RULES)
    href = HREF.replace("'", "''")
    return rf"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS row_id, page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules AS (SELECT * FROM (VALUES {rules}) v(says, h, start)
), fits AS (
  SELECT row_id, arg_max(h || start, (length(h || start), h)) AS rule, arg_max(says, (length(h || start), h)) AS by_rule
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY row_id
), judged AS (SELECT * FROM p LEFT JOIN fits USING (row_id)
), votes AS (SELECT host, count(*) FILTER (WHERE by_rule = 'allow') / count(*) AS trust, count(*) FILTER (WHERE by_rule = 'block') / count(*) AS distrust FROM judged WHERE by_rule IS NOT NULL GROUP BY host
), seeds AS (SELECT 'trust' AS kind, host, trust AS mass FROM votes WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust FROM votes WHERE distrust > 0
), links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM p
), named AS (SELECT src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst FROM links
), pairs AS (SELECT src, dst, count(*) AS n FROM named WHERE src != '' AND dst != '' AND src != dst GROUP BY src, dst
), edges AS (
  SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM pairs
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM pairs
), ranks(k, kind, host, score) AS (
  SELECT 0, kind, host, mass FROM seeds
  UNION ALL
  SELECT k + 1, kind, host, sum(score) FROM (
    SELECT k, r.kind, e.dst AS host, score * w * {DAMPING} AS score FROM ranks r JOIN edges e ON r.kind = e.kind AND r.host = e.src
    UNION ALL SELECT k, s.kind, s.host, mass * (1 - {DAMPING}) FROM seeds s, (SELECT DISTINCT k FROM ranks) z
  ) WHERE k < 88 GROUP BY k, kind, host
), bad AS (
  SELECT host FROM ranks WHERE k = 88 GROUP BY host
  HAVING sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) - {RATIO} * sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) > {TOLERANCE}
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""


#: The same rules and power iteration, with the greatest number of rounds that the tolerance can ask for.
ORACLE = _oracle()
