"""Judging urls by rules and by trust that spreads over links between hosts."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import stored
from runloom.plans.joins import lookup_join
from runloom.plans.rounds import RoundTables

# The chance that a walk goes on along a link, and the share of its score that a round may
# still bring to any host when the walk ends. From then on no round brings a host more than
# that share, and all of them together at most TOLERANCE / (1 - DAMPING) of all mass.
DAMPING = 0.85
TOLERANCE = 1e-9
# A host that is reached has at least this score (the least normal double), however far it is.
REACHED = sys.float_info.min
# A host is blocked when its distrust passes its trust by this share of the two.
MARGIN = 0.0
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def _split(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    found = at > 0
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return (F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(verdict, rule)``, else null.

    A rule is ``host/path``: it fits its host and all subdomains if the path starts with its
    own. The rules are a parameter, so they are tried as expressions, longest first.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(
            path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
                     ).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: how many links lead from pages of one host to another.

    Only absolute links and those that start with ``//host`` leave a host; they are counted
    before anything is shuffled. Links within a host carry no trust to others and are left out.
    """
    host, _ = _split(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(
        F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    link = F.col("link")
    target, _ = _split(F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link))
                       .otherwise(link))
    return (
        links.select("src", target.alias("dst"))
        .where("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def personalised_rank(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """``(host, score)``: where walks from the seeds end, by power iteration.

    ``edges`` (src, dst, weight) are followed by weight; ``seeds`` (host, seed) say where walks
    start, as shares of 1. A walk at a host without links ends there. Every round moves what the
    round before brought, as one join and one aggregate, written to the shared folder. Rounds go
    on until none brings any host more than ``tolerance`` of its score: a host that is reached
    for the first time gets all of its score, so every host that links lead to is reached.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = stored(
        edges.join(total, "src").select(
            "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    if shares.isEmpty():
        return start
    rounds = RoundTables(edges.sparkSession, "scores")
    scores, _ = rounds.write(start.select("host", "score", F.col("score").alias("moved")))
    while not scores.where(F.col("moved") > tolerance * F.col("score")).isEmpty():
        moved = (
            shares.join(scores.where("moved > 0").select(
                F.col("host").alias("src"), F.col("moved").alias("before")), "src")
            .groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("share") * F.col("before") * damping).alias("moved")))
        old, brought = F.sum("score"), F.sum("moved")
        brought = F.when(old == 0, F.greatest(brought, F.lit(REACHED))).otherwise(brought)
        scores, _ = rounds.write(
            scores.select("host", "score", F.lit(0.0).alias("moved"))
            .unionByName(moved.select("host", F.lit(0.0).alias("score"), "moved"))
            .groupBy("host").agg((old + brought).alias("score"), brought.alias("moved")))
    return scores.select("host", "score")


def judge_hosts(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(host, trust, distrust)`` of every host.

    Seeds are the hosts of pages that a rule allows or blocks, by their share of such pages.
    Trust follows links forward from the allowed ones, distrust follows them backward from the
    blocked ones: who links to blocked hosts is suspect.
    """
    host, path = _split(F.col("url"))
    judged = pages.select(host.alias("host"), path.alias("path"))
    verdict = rule_of(F.col("host"), F.col("path"), rules)["verdict"]
    counted = stored(judged.groupBy("host").agg(
        F.sum((verdict == "allow").cast("int")).alias("allowed"),
        F.sum((verdict == "block").cast("int")).alias("blocked")), "hosts")
    sums = counted.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    edges = stored(host_edges(pages), "host-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def seeds(column: str, total: int | None) -> DataFrame:
        return counted.where(F.col(column) > 0).select(
            "host", (F.col(column) / float(total or 1)).alias("seed"))

    trust = personalised_rank(edges, seeds("allowed", sums["a"]))
    distrust = personalised_rank(back, seeds("blocked", sums["b"]))
    return (
        counted.select("host")
        .join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"),
                F.coalesce("distrust", F.lit(0.0)).alias("distrust")))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], margin: float = MARGIN
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` per row of ``pages``.

    ``rules`` are ``(allow or block, host/path)``. A url without a fitting rule is judged by
    its host: blocked when distrust - trust is more than ``margin`` of their sum, so a host
    that neither reaches is allowed. Null urls and urls without ``://`` have empty host and
    path; null html has no links. Repeated rows are rows like others. No rows give no rows;
    other columns are ignored.
    """
    host, path = _split(F.coalesce("url", F.lit("")))
    hosts = stored(judge_hosts(pages.select(F.coalesce("url", F.lit("")).alias("url"), "html"),
                               rules), "host-scores")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    # All pages of a host look up one row: a table measured to be small is broadcast.
    joined = lookup_join(rows, hosts, ["host"], "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    suspect = (F.col("distrust") - F.col("trust")
               > margin * (F.col("distrust") + F.col("trust")))
    return joined.withColumn("__rule", rule).select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", F.when(suspect, F.lit("block")).otherwise(F.lit("allow")))
        .alias("verdict"), "trust", "distrust")
