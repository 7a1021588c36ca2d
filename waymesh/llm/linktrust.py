"""Url verdicts: rules by host and path first, then trust and distrust that flow over the links between hosts.

Trust starts at hosts that a rule allows as a whole and follows links; distrust starts at hosts of which a rule blocks at
least half the pages and flows against them, so a host that links to bad hosts is suspected. Both are personalised
PageRanks over weighted host edges. Only DataFrame functions are used.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Verdict, host, start of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS = 0.85, 10
BLOCKED_PART = 0.5
MARGIN = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links of a host's pages to other hosts, each source's weights adding up to 1."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)"), F.lit(1))
    pairs = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.transform(links, host_of)).alias("dst")).where("src != dst and src != '' and dst != ''")
    counts = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    totals = counts.groupBy("src").agg(F.sum("n").alias("total"))
    return counts.join(totals, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, score``: personalised PageRank of ``seeds`` (``host, mass`` adding up to 1), lineage cut each round.

    A hub's incoming shares are added up before the shuffle; mass that reaches a host without links is not handed on.
    """
    score = seeds.select("host", F.col("mass").alias("score"))
    for _ in range(ROUNDS):
        flow = edges.join(score.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(
            (F.sum(F.col("weight") * F.col("score")) * DAMPING).alias("share"))
        start = seeds.select("host", (F.col("mass") * (1 - DAMPING)).alias("share"))
        score = cut(flow.unionByName(start).groupBy("host").agg(F.sum("share").alias("score")))
    return score


def host_scores(pages: DataFrame) -> DataFrame:
    """``host, trust, distrust`` of every host with a seed or a link. Without links only the seeds have scores."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(host, path)
    whole = F.lit(False)
    for what, of, start in RULES:
        if what == "allow" and start == "/":
            whole = whole | (F.col("host") == of) | F.col("host").endswith("." + of)
    hosts = cut(pages.select(host.alias("host"), verdict.alias("verdict")).groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked")).where("host != ''"))
    good = hosts.where(whole & (F.col("blocked") < BLOCKED_PART * F.col("n")))
    bad = hosts.where((F.col("blocked") >= BLOCKED_PART * F.col("n")))
    edges = cut(host_edges(pages))
    totals = {name: seeds.count() for name, seeds in (("good", good), ("bad", bad))}
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    incoming = backward.groupBy("src").agg(F.sum("weight").alias("total"))
    backward = cut(backward.join(incoming, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight")))
    trust = propagate(edges, good.select("host", F.lit(1.0 / max(1, totals["good"])).alias("mass")))
    distrust = propagate(backward, bad.select("host", F.lit(1.0 / max(1, totals["bad"])).alias("mass")))
    return trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per page; needs ``page_id, url, html``.

    A page that no rule fits is blocked where its host's distrust exceeds MARGIN times its trust, otherwise allowed; null
    urls and urls without a host are allowed. Repeated rows come out once each. The blocked hosts alone meet the pages:
    they are broadcast if counted as few, otherwise joined.
    """
    bad = cut(host_scores(pages).where(F.col("distrust") > MARGIN * F.col("trust")).select("host", F.lit(True).alias("bad_host")))
    if bad.count() <= 100_000:
        bad = F.broadcast(bad)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).join(bad, "host", "left")
    return rows.select("page_id", "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"))
