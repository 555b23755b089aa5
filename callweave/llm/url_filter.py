"""URL filters (operator 5): rules first, then link-graph propagation of trust and distrust over hosts.

All work is DataFrame functions. Trust is a personalised PageRank along links, restarted at hosts that an
allow rule fits; distrust is one against the links, restarted at hosts that a block rule fits. Links are
the absolute URLs in ``href`` and ``src`` of a page, and between the sites of one owner: a host with a
conventional first label (www, m, blog ...) and the host without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import LOWER, UPPER, table
from callweave.session import materialize

#: Rules of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: First labels that name another site of the same owner.
TWIN = r"^(?:www\d?|m|mobile|amp|blog|news|shop)\.(.+\..+)$"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or none: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule (null: none); of equally long ones a block rule wins."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)`` between different hosts, from the links of all pages and between twin sites."""
    hosts = pages.select(host_of(F.col("url")).alias("src"), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)).alias("links")).where("src <> ''")
    linked = hosts.select("src", F.explode("links").alias("dst")).select("src", F.translate(F.regexp_extract("dst", r"([^@]*)$", 1), UPPER, LOWER).alias("dst"))
    linked = linked.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    known = hosts.select("src").distinct().unionByName(linked.select(F.col("dst").alias("src"))).distinct()
    up = known.select("src", F.regexp_extract("src", TWIN, 1).alias("dst")).where("dst <> ''")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-4, rounds_a_step: int = 6) -> DataFrame:
    """``(host, trust, distrust)``, each way with a sum of one. ``seeds(host, way, weight)``: way is trust or distrust.

    The restart weights of each way are scaled to a sum of one. Rounds end when no score of either way changed by
    more than ``tolerance`` of itself in a step; a host that is just reached changes by all of its score, so every host that
    links lead to is scored, however far. Mass of hosts without links is dropped and the ways are divided by what
    is left of them. Each round is one join and one partial aggregate, cut by a written table; one number a round
    reaches the driver.
    """
    ways = links.select(F.lit("trust").alias("way"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("way", "src").agg(F.sum("n").alias("all"))
    steps = materialize(ways.join(out, ["way", "src"]).select("way", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")))
    total = seeds.groupBy("way").agg(F.sum("weight").alias("all"))
    start = materialize(seeds.join(F.broadcast(total), "way").select("way", "host", (F.col("weight") / F.col("all")).alias("score")))
    scores = start
    change = 1.0
    while change > tolerance:
        before = scores.select("way", "host", F.lit(0.0).alias("score"), F.col("score").alias("old"))
        for k in range(rounds_a_step):
            none = F.lit(0.0).alias("old")
            moved = steps.join(scores, ["way", "host"]).select("way", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"), none)
            back = start.select("way", "host", ((1 - damping) * F.col("score")).alias("score"), none)
            both = moved.unionByName(back)
            if k == rounds_a_step - 1:
                both = both.unionByName(before)
            both = both.groupBy("way", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")).where("score > 0")
            scores = both.select("way", "host", "score")
        both = materialize(both)
        change = both.agg(F.max(F.abs(F.col("score") - F.col("old")) / F.col("score"))).first()[0] or 0.0
        scores = both.select("way", "host", "score")
    left = scores.groupBy("way").agg(F.sum("score").alias("all"))
    scores = scores.join(F.broadcast(left), "way").select("way", "host", (F.col("score") / F.col("all")).alias("score"))
    pick = lambda way: F.sum(F.when(F.col("way") == way, F.col("score")).otherwise(0.0)).alias(way)
    return scores.groupBy("host").agg(pick("trust"), pick("distrust"))


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, *, ratio: float = 1.0, floor: float = 0.0, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` and the host's ``trust`` and ``distrust``.

    Where no rule fits, a host is blocked if its distrust is over ``floor`` and over ``ratio`` times its trust;
    hosts that nothing reaches, empty hosts and null urls are allowed. Repeated rows are kept. Null html has
    no links. Extra columns are ignored. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    way = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("way")
    seeds = judged.where("ruled is not null and host <> ''").groupBy("host", way).agg(F.count("*").cast("double").alias("weight"))
    scores = propagate(materialize(host_links(pages)), seeds, damping=damping, tolerance=tolerance)
    found = judged.join(scores, "host", "left")
    bad = (F.col("distrust") > floor) & (F.col("distrust") > ratio * F.col("trust"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over ``pages`` with ``RULES``. Null urls have an empty host and are allowed; an empty table gives no rows."""
    return url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
