"""Comparison of two scans by the signature of their findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.text import fixed

# Fixed value: how much of the content takes part in a signature.
SIGNATURE_CONTENT = 50
DEFAULT_KEYS = ("location", "pii_type", "content")


def _signature(keys: Sequence[str]) -> list[Column]:
    return [
        (F.left(F.col(k), F.lit(SIGNATURE_CONTENT)) if k == "content" else F.col(k)).alias(k) for k in keys
    ]


def signatures(findings: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The distinct signatures of a scan."""
    return findings.select(*_signature(keys)).distinct()


def last_per_signature(
    findings: DataFrame, order: Column, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """One finding per signature; the last in ``order`` wins.

    ``max_by`` is combined before the shuffle, so a signature shared by very many
    findings sends one row per task instead of all of them.
    """
    value = F.struct("severity", "confidence")
    return (
        findings.select(*_signature(keys), value.alias("v"), order.alias("o"))
        .groupBy(*keys)
        .agg(F.max_by("v", "o").alias("v"))
        .select(*keys, F.col("v.severity").alias("severity"), F.col("v.confidence").alias("confidence"))
    )


def compare(
    baseline: DataFrame,
    current: DataFrame,
    *,
    order: Column,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """``new``, ``resolved``, ``modified`` and ``unchanged`` signatures of two scans.

    Both sides are unique per signature when they meet, so one co-partitioned full
    outer join answers all four questions without skew.
    """
    old = last_per_signature(baseline, order, keys).select(
        *keys, F.col("severity").alias("baseline_severity"), F.col("confidence").alias("baseline_confidence"),
        F.lit(True).alias("in_baseline"),
    )
    new = last_per_signature(current, order, keys).select(
        *keys, F.col("severity").alias("current_severity"), F.col("confidence").alias("current_confidence"),
        F.lit(True).alias("in_current"),
    )
    changed = (F.col("baseline_severity") != F.col("current_severity")) | (
        F.col("baseline_confidence") != F.col("current_confidence")
    )
    kind = (
        F.when(F.col("in_baseline").isNull(), "new")
        .when(F.col("in_current").isNull(), "resolved")
        .when(changed, "modified")
        .otherwise("unchanged")
    )
    # Keys may be null (a location, say) and are then equal to each other.
    other = new.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    joined = old.join(other, same, "full_outer")
    shown = [F.when(F.col("in_baseline").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    rest = ("baseline_severity", "baseline_confidence", "current_severity", "current_confidence")
    return joined.select(*shown, *rest, kind.alias("change_type"))


def signature_digest(keys: Sequence[str] = DEFAULT_KEYS, salt: str = "") -> Column:
    """One column for a signature whose keys have been cut already: a digest of the keys, each behind its length, null apart from empty.

    Short values can be guessed from a plain digest; ``salt`` keeps others from trying.
    """
    parts = [F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)), F.lit("-")) for k in keys]
    return F.sha2(F.concat(F.lit(salt), *parts), 256).alias("signature")


def compare_stored(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``compare`` for two scans kept by ``reports.store_signatures``, by digest instead of keys.

    Both are bucketed by the digest, one row each, so neither side is shuffled however often they are compared; scans with different
    numbers of buckets compare as well, with a shuffle.
    """
    columns = ("pii_type", "severity", "confidence")
    old, new = (df.select("signature", *[F.col(c).alias(f"{side}_{c}") for c in columns], F.lit(True).alias(f"in_{side}"))
                for df, side in ((baseline, "baseline"), (current, "current")))
    changed = (F.col("baseline_severity") != F.col("current_severity")) | (F.col("baseline_confidence") != F.col("current_confidence"))
    kind = (
        F.when(F.col("in_baseline").isNull(), "new")
        .when(F.col("in_current").isNull(), "resolved")
        .when(changed, "modified")
        .otherwise("unchanged")
    )
    # A full outer merge join keeps the buckets' order; a broadcast side would be read whole by every task.
    return old.join(new.hint("merge"), "signature", "full_outer").select(
        "signature", F.coalesce("baseline_pii_type", "current_pii_type").alias("pii_type"),
        "baseline_severity", "baseline_confidence", "current_severity", "current_confidence", kind.alias("change_type"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: the four counts, net change and trend."""
    kinds = ("new", "resolved", "modified", "unchanged")
    counts = diff.agg(*[F.count_if(F.col("change_type") == k).alias(f"{k}_count") for k in kinds])
    net = F.col("new_count") - F.col("resolved_count")
    trend = F.when(net > 0, "worse").when(net < 0, "better").otherwise("stable")
    return counts.withColumns({"net_change": net, "trend": trend})


def signature_sets(baseline: DataFrame, current: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The same three sets by set algebra: a cross-check of ``compare``."""
    a, b = signatures(baseline, keys), signatures(current, keys)
    return (
        b.subtract(a).withColumn("membership", F.lit("current only"))
        .unionByName(a.subtract(b).withColumn("membership", F.lit("baseline only")))
        .unionByName(a.intersect(b).withColumn("membership", F.lit("both")))
    )


def _two_counts(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Counts of both scans per value. One aggregate over the union needs no join."""
    both = baseline.select(column, F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(
        current.select(column, F.lit(0).alias("b"), F.lit(1).alias("c"))
    )
    return both.groupBy(column).agg(F.sum("b").alias("baseline"), F.sum("c").alias("current")).withColumn(
        "change", F.col("current") - F.col("baseline")
    )


def severity_shift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    percent = F.when(F.col("baseline") > 0, F.col("change") / F.col("baseline") * 100).otherwise(0.0)
    return _two_counts(baseline, current, "severity").withColumn("percent_change", percent)


def type_shift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Types that appeared, disappeared, or changed in number; equal ones are left out."""
    status = (
        F.when(F.col("baseline") == 0, "new")
        .when(F.col("current") == 0, "removed")
        .when(F.col("change") != 0, "changed")
    )
    return _two_counts(baseline, current, "pii_type").withColumn("status", status).filter(F.col("status").isNotNull())


def type_sets(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Which types occur in either scan, only one, or both."""
    a, b = baseline.select("pii_type").distinct(), current.select("pii_type").distinct()
    return (
        a.union(b).distinct().withColumn("membership", F.lit("any"))
        .unionByName(b.subtract(a).withColumn("membership", F.lit("new")))
        .unionByName(a.subtract(b).withColumn("membership", F.lit("removed")))
        .unionByName(a.intersect(b).withColumn("membership", F.lit("common")))
    )


def report_lines(diff: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Lines of a text report with their position ``(section, sort_key, part)``.

    ``baseline`` and ``current`` are one-row tables ``(scan_id, timestamp string,
    total_findings)``. The lines are returned as rows, so a long report is sorted and
    written in parallel (``sinks.write_report``).
    """
    bar, rule = "=" * 80, "-" * 80

    def block(rows: DataFrame, section: int, texts: Sequence[Column]) -> DataFrame:
        lines = F.array(*[F.struct(F.lit(i).alias("part"), t.alias("line")) for i, t in enumerate(texts)])
        return rows.select(F.lit(section).alias("section"), F.lit("").alias("sort_key"), F.inline(lines))

    def facts(title: str) -> list[Column]:
        return [
            F.concat(F.lit(f"{title} Scan: "), F.col("scan_id")),
            F.concat(F.lit("  Timestamp: "), F.coalesce("timestamp", F.lit("None"))),
            F.concat(F.lit("  Total Findings: "), F.col("total_findings").cast("string")),
            F.lit(""),
        ]

    head = [F.lit(bar), F.lit("SCAN COMPARISON REPORT"), F.lit(bar), F.lit("")]
    summary = [
        F.lit("SUMMARY"),
        F.lit(rule),
        F.format_string("  New Findings:       %d", "new_count"),
        F.format_string("  Resolved Findings:  %d", "resolved_count"),
        F.format_string("  Modified Findings:  %d", "modified_count"),
        F.format_string("  Unchanged Findings: %d", "unchanged_count"),
        F.format_string("  Net Change:         %+d", "net_change"),
        F.concat(F.lit("  Trend:              "), F.upper("trend")),
        F.lit(""),
    ]
    out = (
        block(baseline, 1, head + facts("Baseline"))
        .unionByName(block(current, 2, facts("Current")))
        .unionByName(block(diff_summary(diff), 3, summary))
    )

    place = F.concat(F.col("pii_type"), F.lit(" at "), F.col("location"))
    where = F.concat_ws("|", "location", "pii_type", *[c for c in diff.columns if c == "content"])
    sections = (
        ("new", 4, "NEW FINDINGS", [
            F.concat(F.lit("  ["), F.upper("current_severity"), F.lit("] "), place,
                     F.lit(" (confidence: "), fixed(F.col("current_confidence")), F.lit(")"))]),
        ("resolved", 5, "RESOLVED FINDINGS", [F.concat(F.lit("  ["), F.upper("baseline_severity"), F.lit("] "), place)]),
        ("modified", 6, "MODIFIED FINDINGS", [
            F.concat(F.lit("  "), place),
            F.concat(F.lit("    Severity: "), F.col("baseline_severity"), F.lit(" -> "), F.col("current_severity")),
            F.concat(F.lit("    Confidence: "), fixed(F.col("baseline_confidence")), F.lit(" -> "),
                     fixed(F.col("current_confidence")))]),
    )
    for kind, section, title, texts in sections:
        rows = diff.filter(F.col("change_type") == kind)
        lines = F.array(*[F.struct(F.lit(i).alias("part"), t.alias("line")) for i, t in enumerate(texts)])
        body = rows.select(F.lit(section).alias("section"), where.alias("sort_key"), F.inline(lines))
        # One group without keys: the heading appears only where there are rows.
        any_ = rows.agg(F.count("*").alias("n")).filter(F.col("n") > 0)
        heading = F.array(
            F.struct(F.lit("").alias("sort_key"), F.lit(0).alias("part"), F.lit(title).alias("line")),
            F.struct(F.lit("").alias("sort_key"), F.lit(1).alias("part"), F.lit(rule).alias("line")),
            F.struct(F.lit("\uffff").alias("sort_key"), F.lit(0).alias("part"), F.lit("").alias("line")),
        )
        out = out.unionByName(body).unionByName(any_.select(F.lit(section).alias("section"), F.inline(heading)))
    end = diff_summary(diff.limit(0)).select(
        F.lit(9).alias("section"), F.lit("").alias("sort_key"), F.lit(0).alias("part"), F.lit(bar).alias("line")
    )
    return out.unionByName(end)
