"""URL filters: path rules, and trust and distrust propagated over the host graph.

Every url is first judged by the longest rule that fits it. The rules' pages are the seeds: a host's
trusted seed is the number of its pages that a rule allows, its distrusted seed the number that a
rule blocks. Links in the pages' html give edges between hosts (weight: how often, links inside a
host don't count). Two personalised PageRanks run over them, r = (1 - d) * seed + d * (what neighbours
pass on + what hosts without neighbours to pass on to give back to the seeds, in proportion): trust along
the links, from trusted seeds; distrust against them, from blocked seeds, since who links to a blocked
host vouches for it. No rank is lost, so both add up to their seeds; they count per page of a host. What
a blocked host passes back is dealt among all that link to it, so it thins out with their number; a host's
distrust is therefore at least the share of walks from its pages along links (going on with d at each
step) that meet a blocked page, which no other linker changes. A host is blocked if its distrust exceeds
its trust and is at least ``share``, by default half.

Ranks only grow from round to round, so their growth is their distance: the rounds end when it is
at most ``TOLERANCE`` of the ranks, and after ``rounds`` at the latest.

Ranks are whole numbers of ``UNIT``, so sums don't depend on the order of rows. All of it is joins
and grouped sums per host in Spark; each round is written to the shared folder.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule, and are
judged as one host without links; null html has no links; rows that repeat a page_id are judged each
by its own url and count as pages; null page_ids stay; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import common

#: (verdict, host, path) as the query's contract states them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UNIT = 1 << 20
TOLERANCE = 0.005
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict by rule or null)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host."""
    links = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), 1))
    linked = pages.where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), links.alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return linked.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(host, rank) from seeds (host, seed) over edges (src, dst, n): personalised PageRank in whole units; hosts without edges give back to the seeds."""
    spark = edges.sparkSession
    sown = common.materialise(spark, seeds.where("seed > 0").select("host", (F.col("seed") * UNIT).alias("rank")), "seeds")
    total = sown.agg(F.sum("rank")).first()[0]
    if not total:
        return sown
    out = edges.groupBy(F.col("src").alias("_src")).agg(F.sum("n").alias("_out"))
    flow = common.materialise(spark, edges.join(out, F.col("src") == F.col("_src")).select("src", "dst", (F.col("n") / F.col("_out") * damping).alias("part")), "flow")
    return spread(flow, sown, rounds, damping, total)


def vouched(edges: DataFrame, hosts: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(host, rank) from hosts (host, n_pages, blocked): in whole units, the share of walks along edges (src, dst, n) that meet a blocked page."""
    spark = edges.sparkSession
    out = edges.groupBy(F.col("src").alias("_src")).agg(F.sum("n").alias("_out"))
    left = out.join(hosts, F.col("host") == F.col("_src")).select("_src", (damping * (1 - F.coalesce("blocked", F.lit(0)) / F.col("n_pages")) / F.col("_out")).alias("_each"))
    flow = common.materialise(spark, edges.join(left, F.col("src") == F.col("_src")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") * F.col("_each")).alias("part")), "flow")
    own = hosts.where("blocked > 0").select("host", F.floor(F.col("blocked") / F.col("n_pages") * UNIT).cast("long").alias("rank"))
    return spread(flow, common.materialise(spark, own, "blocked"), rounds)


def spread(flow: DataFrame, own: DataFrame, rounds: int, damping: float | None = None, total: int = 0) -> DataFrame:
    """(host, rank) after rounds of passing ``part`` of the rank from src to dst, beside what is a host's ``own``.

    With ``damping``, ``own`` are seeds that add up to ``total``: 1 - damping of each is given in every round, and in proportion to them what
    the last round passed to nobody."""
    spark = flow.sparkSession
    if not flow.limit(1).count():
        return own
    given = 1.0 if damping is None else 1 - damping
    base = lambda share: own.select("host", F.floor(F.col("rank") * share).cast("long").alias("rank"))
    now = common.materialise(spark, base(given), "rank")
    size = now.agg(F.sum("rank")).first()[0] or 0
    for _ in range(rounds):
        passed = now.join(flow, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.floor(F.col("rank") * F.col("part"))).cast("long").alias("rank"))
        passed = common.materialise(spark, passed, "passed")
        back = 0.0 if damping is None else max(0.0, damping * size - (passed.agg(F.sum("rank")).first()[0] or 0)) / total
        after = common.materialise(spark, base(given + back).union(passed).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        grown = after.agg(F.sum("rank")).first()[0] or 0
        common.discard(spark, now)
        common.discard(spark, passed)
        now, before, size = after, size, grown
        if size - before <= TOLERANCE * size:
            break
    return now


def filter_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int = 60, share: float = 0.5) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, and the host's trust and distrust per page."""
    spark = pages.sparkSession
    marked = common.materialise(spark, judged(pages, rules), "pages")
    hosts = common.materialise(spark, marked.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum((F.col("verdict") == "allow").cast("long")).alias("allowed"), F.sum((F.col("verdict") == "block").cast("long")).alias("blocked")), "hosts")
    edges = common.materialise(spark, host_edges(pages), "host-edges")
    trust = propagate(edges, hosts.select("host", F.col("allowed").alias("seed")), damping, rounds)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, hosts.select("host", F.col("blocked").alias("seed")), damping, rounds)
    walks = vouched(edges, hosts, damping, rounds)
    mass = F.col("n_pages") * UNIT
    scored = hosts.join(trust.withColumnRenamed("rank", "t"), "host", "left").join(distrust.withColumnRenamed("rank", "d"), "host", "left").join(walks.withColumnRenamed("rank", "w"), "host", "left")
    scored = scored.select(F.col("host").alias("_host"), "n_pages", (F.coalesce("t", F.lit(0)) / mass).alias("trust"), F.greatest(F.coalesce("d", F.lit(0)) / mass, F.coalesce("w", F.lit(0)) / UNIT).alias("distrust"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= share)
    bad = common.materialise(spark, scored.select(F.col("_host").alias("host"), "n_pages", bad.alias("bad"), "trust", "distrust"), "host-verdicts")
    told = common.join_skewed(marked, bad, "host", "n_pages")  # a host may have a third of all pages
    return told.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: host, path, rule and the rule's verdict of all ``pages``."""
    return judged(common.table(spark, sf_dir, "pages")).withColumnRenamed("verdict", "rule_verdict")


RULES_ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, '.' || host AS dotted FROM h),
r AS (SELECT page_id, host, path, CASE
  WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict FROM r
"""


def op5_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all ``pages``: page_id, host, path, rule, verdict, trust, distrust; null, repeated and missing rows as the module states."""
    return filter_urls(common.table(spark, sf_dir, "pages"))
