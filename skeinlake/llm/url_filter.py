"""URL filter: rules of hosts and paths, and trust and distrust that spread over links between hosts.

Rules decide first.  Hosts with pages that rules allow are seeds of trust, hosts with pages that rules block are seeds of
distrust, each weighted by the share of such pages.  Personalised PageRank carries trust along links, and distrust
against them, to the hosts that link to distrusted ones.  A page that no rule fits is blocked where its host's
distrust reaches a threshold and exceeds its trust.

All steps are DataFrame functions.  Pages of one host are counted before they are shuffled; a link counts once for a pair
of hosts.  A null url, or one without "://", has an empty host and path, which no rule fits and which is no host of the graph.
Null html has no links.  Repeated rows count as pages of their own.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_stage, stage, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts that absolute links name; links within a site need none.
LINK = r"""(?i)\bhref[\x20\x09-\x0D]{0,9}=[\x20\x09-\x0D]{0,9}["']?(?:https?:)?//([^/?#"'\x20\x09-\x0D<>]+)"""
#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: What is left of a seed's weight after the last round.
LEFT_OVER = 1e-4
#: A host has 0.15 of its own if rules block all its pages, and about this much if they block just over half of them.
DISTRUST = 0.077


def _after_scheme(url: Column) -> Column:
    """What follows the first "://"; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def _lowered(host: Column) -> Column:
    return F.translate(host, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(_lowered(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and verdict to pages of host and path: those of the longest rule that fits, else null.

    Each distinct host meets the rules of its suffixes, of as many labels as the longest rule has; its pages then take the longest
    whose path theirs begins with.  Of rules of equal host and path, a block wins.
    """
    labels = F.size(F.split("rule_host", r"\."))
    most = rules.agg(F.max(labels)).first()[0] or 0
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.lit(most) > 0)
    found = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    order = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), "rule_verdict", F.concat("rule_host", "rule_path").alias("rule"), "rule_path")
    candidates = stage(found.groupBy("host").agg(F.sort_array(F.collect_set(order), asc=False).alias("candidates")), "url-rules")
    fits = F.filter("candidates", lambda c: F.col("path").startswith(c["rule_path"]))
    best = F.try_element_at(fits, F.lit(1))
    return pages.join(candidates, "host", "left").withColumns({"rule": best["rule"], "verdict": best["rule_verdict"]}).drop("candidates")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst: distinct pairs of hosts, of which a page of the first links to the second."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), _lowered))).alias("dst"))
    return links.where("src <> '' AND dst <> src").distinct()


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, left_over: float = LEFT_OVER) -> DataFrame:
    """host, trust and distrust of links (src, dst) and seeds (host, trust, distrust), by power iteration.

    A host deals its trust out in equal parts to the hosts that it links to, and its distrust to those that link to it; seeds
    get theirs anew in each round.  Rounds are as many as `left_over` needs: each multiplies what is on the way by the damping.
    """
    trust, distrust = F.lit("trust").alias("kind"), F.lit("distrust").alias("kind")
    both = links.select(trust, F.col("src").alias("host"), F.col("dst").alias("to")).unionByName(links.select(distrust, F.col("dst").alias("host"), F.col("src").alias("to")))
    out = both.groupBy("kind", "host").agg(F.count("*").alias("links"))
    edges = stage(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.lit(damping) / F.col("links")).alias("share")), "url-edges")
    own = seeds.select(trust, "host", F.col("trust").alias("score")).unionByName(seeds.select(distrust, "host", F.col("distrust").alias("score")))
    own = stage(own.where("score > 0").withColumn("score", F.col("score") * (1 - damping)), "url-seeds")
    now = own
    for _ in range(0 if edges.isEmpty() else math.ceil(math.log(left_over) / math.log(damping))):
        dealt = edges.join(now, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        step = stage(dealt.unionByName(own).groupBy("kind", "host").agg(F.sum("score").alias("score")), "url-scores")
        if now is not own:
            remove_stage(now)
        now = step
    by_kind = {kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)) for kind in ("trust", "distrust")}
    return now.groupBy("host").agg(*(score.alias(kind) for kind, score in by_kind.items()))


def judge(pages: DataFrame, rules: DataFrame, threshold: float = DISTRUST) -> DataFrame:
    """page_id, host, path, rule and verdict of each page (page_id, url, html); rules have rule_verdict, rule_host, rule_path."""
    url = F.col("url")
    judged = by_rules(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")), rules)
    judged = stage(judged, "url-judged")
    share = {kind: F.avg(F.when(F.col("verdict") == verdict, 1.0).otherwise(0.0)) for kind, verdict in (("trust", "allow"), ("distrust", "block"))}
    seeds = judged.where("host <> ''").groupBy("host").agg(*(s.alias(kind) for kind, s in share.items()))
    scores = propagate(stage(host_links(pages), "url-links"), seeds)
    shunned = stage(scores.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("shunned")), "url-shunned")
    spread = F.when(F.col("shunned"), "block").otherwise("allow")
    return judged.join(shunned, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", spread).alias("verdict"))


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """A row for each (verdict, host, path)."""
    names = ("rule_verdict", "rule_host", "rule_path")
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, rule, strict=True))) for rule in rules))
    return spark.range(1).select(F.inline(rows))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules_table(spark))
