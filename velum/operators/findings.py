"""The ``findings`` table: hits graded by severity, articles and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions import grading

REDACTED = "[REDACTED]"
ANALYZER_VERSION = "1.0.0"

FINDINGS_SCHEMA = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("finding_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("pii_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("gdpr_articles", T.ArrayType(T.StringType())),
        T.StructField("gdpr_reasoning", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("anonymization_strategy", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("analyzer_version", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("column_number", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
    ]
)

FINDING_FIELDS = tuple(f.name for f in FINDINGS_SCHEMA.fields)


def conform(df: DataFrame) -> DataFrame:
    """Cast to the findings schema; fields the producer does not know become null."""
    known = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FINDINGS_SCHEMA.fields
        ]
    )


def finding_id(source: Column, location: Column, pii_type: Column, start: Column, section: Column | None = None) -> Column:
    """Reproducible identifier: the same hit gets the same id in every run.

    ``section`` tells apart sources of the same name, such as files of two folders.
    """
    parts = [source, location, pii_type, start.cast("string")]
    return F.sha2(F.concat_ws("|", *([section] if section is not None else []), *parts), 256)


def to_findings(
    hits: DataFrame,
    *,
    scan_id: Column,
    source: Column,
    location: Column | None = None,
    source_type: str = "document",
    page_number: Column | None = None,
    ts: Column | None = None,
    section: Column | None = None,
) -> DataFrame:
    """Grade the rows of a detection with the profile of their kind of source."""
    page = F.lit(None).cast("int") if page_number is None else page_number
    where = grading.location_label(page) if location is None else location
    kind = F.col("pii_type")
    sev = grading.severity(kind, F.col("confidence"), source_type)
    return conform(
        hits.select(
            scan_id.cast("string").alias("scan_id"),
            finding_id(source.cast("string"), where, kind, F.col("start"), section).alias("finding_id"),
            source.cast("string").alias("source"),
            F.lit(source_type).alias("source_type"),
            where.alias("location"),
            "pii_type",
            F.col("value").alias("content"),
            "context",
            "start",
            "end",
            "seq",
            "confidence",
            sev.alias("severity"),
            grading.articles(kind, source_type).alias("gdpr_articles"),
            grading.advice(kind, sev, source_type).alias("recommendation"),
            (F.lit(None).cast("timestamp") if ts is None else ts).alias("ts"),
            F.lit(ANALYZER_VERSION).alias("analyzer_version"),
            page.alias("page_number"),
        )
    )


def redacted(findings: DataFrame) -> DataFrame:
    """Findings with every detected value hidden."""
    return findings.withColumn("content", F.lit(REDACTED))


def merge(*tables: DataFrame) -> DataFrame:
    """Findings of several detectors or sources as one table."""
    out = conform(tables[0])
    for t in tables[1:]:
        out = out.unionByName(conform(t))
    return out


def scans_from(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """One row per scan. With ``scans`` given, scans without findings are kept as well."""
    totals = findings.groupBy("scan_id").agg(F.count("*").alias("total_findings"))
    if scans is None:
        return totals
    return scans.join(totals, "scan_id", "left").withColumn(
        "total_findings", F.coalesce("total_findings", F.lit(0).cast("long"))
    )


def type_counts_by_scan(findings: DataFrame) -> DataFrame:
    """How often each type occurs in its scan: partial sums first, then one row per scan and type."""
    return findings.groupBy("scan_id", "pii_type").agg(F.count("*").alias("type_count"))


def with_type_count(findings: DataFrame) -> DataFrame:
    """Each finding with the count of its type in its scan.

    An aggregate joined back instead of a window: a window would sort all findings of
    one scan and type in a single task, while the join lets skewed keys be split.
    """
    return findings.join(type_counts_by_scan(findings), ["scan_id", "pii_type"])
