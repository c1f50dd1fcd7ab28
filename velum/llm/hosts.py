"""URL verdicts from rules and, where no rule fits, from trust that spreads over the links between hosts.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks distrusted ones,
each weighted by its pages. Trust is personalised PageRank from the trusted seeds along links; distrust is
the same from the distrusted seeds against them: who links to a blocked host shares its distrust. A page
without a rule is blocked if its host's distrust exceeds its trust by more than a margin, else allowed.

The host of a null url, or one without ``://``, is empty, as is its path; no rule fits it. A null page text
has no links, links within a host do not count, and a link is read from any ``href`` with a host. Repeated
pages get repeated rows and count as often as they stand. An empty table gives an empty result. Columns
other than id, url and page text are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.session import materialize

#: ``(verdict, host, path)``; a rule list of this kind is written by hand.
Rule = tuple[str, str, str]
MAX_RULES = 500
DAMPING, ROUNDS, MARGIN = 0.85, 15, 0.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst, n)``: links between different hosts, counted before they are shuffled."""
    links = F.explode(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)))
    found = pages.select(host_of(F.col(url)).alias("src"), links.alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    found = found.select("src", host_of(absolute).alias("dst"))
    return found.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``(host, rank)``: personalised PageRank over ``(src, dst, n)`` from ``(host, weight)``.

    What reaches a host without links goes back to the seeds. Each round joins ranks to links, sums
    them with partial sums and is written to the shared folder.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    start = seeds.select("host", (F.col("weight") / F.lit(total or 1)).alias("weight")).filter(F.col("weight") > 0)
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    steps = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "links")
    start = materialize(start, "seeds")
    ranks = start.withColumnRenamed("weight", "rank")
    if not total or steps.isEmpty():
        return ranks
    for _ in range(rounds):
        flow = ranks.join(steps, ranks["host"] == steps["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        flow = materialize(flow, "flow")
        back = 1.0 - damping * (flow.agg(F.sum("flow")).first()[0] or 0.0)
        both = flow.select(F.col("dst").alias("host"), (F.col("flow") * damping).alias("rank")).union(
            start.select("host", (F.col("weight") * back).alias("rank")))
        ranks = both.groupBy("host").agg(F.sum("rank").alias("rank"))
    return materialize(ranks, "ranks")


def verdicts(pages: DataFrame, rules: Sequence[Rule], *, key: str = "page_id", url: str = "url", html: str = "html",
             damping: float = DAMPING, rounds: int = ROUNDS, margin: float = MARGIN) -> DataFrame:
    """``(key, host, path, rule, verdict, trust, distrust)`` for every row of ``pages``."""
    judged = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.select(key, "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict"))
    edges = materialize(host_links(pages, url, html), "host-links")
    counts = materialize(
        judged.filter(F.col("host") != "").groupBy("host").agg(
            F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")),
        "host-seeds")
    trust = spread_rank(edges, counts.select("host", F.col("allowed").alias("weight")), damping, rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread_rank(back, counts.select("host", F.col("blocked").alias("weight")), damping, rounds)
    ranks = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(
        distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    # Sums may differ in their last digits from run to run.
    ranks = ranks.groupBy("host").agg(F.round(F.sum("trust"), 12).alias("trust"), F.round(F.sum("distrust"), 12).alias("distrust"))
    by_rank = F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow")
    return judged.join(ranks, "host", "left").select(
        key, "host", "path", "rule", F.coalesce("verdict", by_rank).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
