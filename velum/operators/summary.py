"""Counts and listings over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import grading
from velum.session import top_n


def by_severity(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys, "severity").agg(F.count("*").alias("count"))


def by_type(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys, "pii_type").agg(F.count("*").alias("count"))


def by_type_and_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pii_type", "severity").agg(
        F.count("*").alias("findings"),
        F.countDistinct("source").alias("sources"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def scan_maps(findings: DataFrame) -> DataFrame:
    """Totals per scan with both count maps. Only finished counts are collected, at most one per type."""
    counts = findings.groupBy("scan_id", "pii_type", "severity").agg(F.count("*").alias("n"))

    def as_map(column: str, name: str) -> DataFrame:
        per = counts.groupBy("scan_id", column).agg(F.sum("n").alias("n"))
        return per.groupBy("scan_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name),
            F.sum("n").alias(f"total_{column}"),
        )

    sev = as_map("severity", "findings_by_severity").withColumnRenamed("total_severity", "total_findings")
    return sev.join(as_map("pii_type", "findings_by_type").drop("total_pii_type"), "scan_id")


def severity_table(findings: DataFrame) -> DataFrame:
    """Counts from critical to low, without empty levels."""
    counted = by_severity(findings).filter(F.col("severity") != "info")
    return counted.withColumn("rank", grading.severity_rank(F.col("severity"))).orderBy("rank")


def type_table(findings: DataFrame) -> DataFrame:
    return by_type(findings).orderBy(F.col("count").desc(), "pii_type")


def details_if_few(findings: DataFrame, limit: int) -> DataFrame:
    """Locations, types, severities and advice, but only when there are at most ``limit`` findings.

    Reading ``limit + 1`` rows is enough to know, so no full count is needed.
    """
    head = findings.select("location", "pii_type", "severity", "recommendation").limit(limit + 1)
    everything = Window.partitionBy(F.lit(0))
    return (
        head.withColumn("__n", F.count("*").over(everything)).filter(F.col("__n") <= limit).drop("__n")
    )


def per_source(findings: DataFrame) -> DataFrame:
    """Findings per source, over all scans."""
    return findings.groupBy("source").agg(F.count("*").alias("findings"))


def batch_statistics(findings: DataFrame) -> DataFrame:
    """One row per batch: findings, sources that have any, and counts by severity.

    Counting per source first keeps the distinct count a plain sum of one row per source.
    """
    per = findings.groupBy("scan_id", "source").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in grading.SEVERITY_ORDER[:4]],
    )
    return per.groupBy("scan_id").agg(
        F.sum("n").alias("total_findings"),
        F.count("*").alias("files_with_findings"),
        *[F.sum(s).alias(s) for s in grading.SEVERITY_ORDER[:4]],
    )


def multi_scan_summary(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Totals, counts by severity, by type and per scan in one pass (grouping sets)."""
    base = findings.groupBy("scan_id", "severity", "pii_type").agg(F.count("*").alias("n"))
    rolled = base.groupingSets(
        [[], [F.col("severity")], [F.col("pii_type")], [F.col("scan_id")]], "severity", "pii_type", "scan_id"
    ).agg(F.sum("n").alias("findings"), F.grouping_id("severity", "pii_type", "scan_id").alias("g"))
    section = (
        F.when(F.col("g") == 7, "total")
        .when(F.col("g") == 3, "severity")
        .when(F.col("g") == 5, "type")
        .otherwise("scan")
    )
    out = rolled.select(
        section.alias("section"),
        F.coalesce("severity", "pii_type", "scan_id", F.lit("all")).alias("key"),
        "findings",
    )
    if scans is None:
        return out
    clean = scans.select("scan_id").join(findings.select("scan_id").distinct(), "scan_id", "left_anti")
    return out.unionByName(
        clean.select(F.lit("scan").alias("section"), F.col("scan_id").alias("key"), F.lit(0).cast("long").alias("findings"))
    )


def type_summary(findings: DataFrame, key: str = "source") -> DataFrame:
    """``TYPE: n`` lists per document, as given to a risk assessment."""
    counts = findings.groupBy(key, "pii_type").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("pii_type", "n")))
    text = F.array_join(
        F.transform(listed, lambda x: F.concat(x["pii_type"], F.lit(": "), x["n"].cast("string"))), ", "
    )
    return counts.groupBy(key).agg(text.alias("summary"), F.sum("n").alias("findings"))


def cooccurrence(found: DataFrame, array: str = "detections") -> DataFrame:
    """How many texts contain both types of a pair.

    Texts are first counted per set of types, so pairs are formed once per distinct
    set and not once per text; ``found`` carries the hits of a text as an array, which
    makes the set a narrow expression.
    """
    types = F.array_sort(F.array_distinct(F.transform(array, lambda d: d["pii_type"])))
    # No filter on the sets: it would be pushed below the count and run the detection twice.
    counted = found.select(types.alias("types")).groupBy("types").agg(F.count("*").alias("n"))
    pairs = F.flatten(
        F.transform(
            "types",
            lambda a: F.transform(
                F.filter("types", lambda b: a < b), lambda b: F.struct(a.alias("type_a"), b.alias("type_b"))
            ),
        )
    )
    rows = counted.select("n", F.inline_outer(pairs)).filter(F.col("type_a").isNotNull())
    return rows.groupBy("type_a", "type_b").agg(F.sum("n").alias("texts"))


def scan_listing(scans: DataFrame, findings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` scans by start time, with totals; findings are counted before the join."""
    first = top_n(scans, [F.col("start_time"), F.col("scan_id")], limit)
    counted = findings.groupBy("scan_id").agg(F.count("*").alias("total_findings"))  # partial sums: a row per task and scan
    return first.join(counted, "scan_id", "left").withColumn(
        "total_findings", F.coalesce("total_findings", F.lit(0).cast("long"))
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, slices: int = 64) -> DataFrame:
    """The first ``n`` rows of each group, safe for groups that hold much of the table.

    Tasks are gathered into ``slices``; a group is cut to ``n`` rows per slice before the
    slices meet, so no task ever sorts a whole hot group. For ``n`` up to 1000 every task
    cuts its own rows before the first shuffle already. The slice of a row does not
    influence the result; ``order`` must be total for a reproducible one.
    """
    sliced = Window.partitionBy(*keys, "__slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__slice", F.spark_partition_id() % slices)
        .withColumn("__rank", F.row_number().over(sliced))
        .filter(F.col("__rank") <= n)
        .withColumn("__rank", F.row_number().over(whole))
        .filter(F.col("__rank") <= n)
        .drop("__rank", "__slice")
    )
