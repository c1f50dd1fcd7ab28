"""Saved scans, audit logs and database tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.operators.audit import AUDIT_SCHEMA
from velum.operators.findings import FINDINGS_SCHEMA


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings saved as JSON lines; the schema is declared, so nothing is inferred."""
    return spark.read.schema(FINDINGS_SCHEMA).json(path)


def read_scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Scans saved as one JSON document each with a ``findings`` list: one row per finding."""
    fields = ", ".join(
        f"`{name}`: {kind}"
        for name, kind in (
            ("id", "string"), ("source", "string"), ("location", "string"), ("pii_type", "string"),
            ("content", "string"), ("context", "string"), ("confidence", "double"), ("severity", "string"),
            ("gdpr_articles", "array<string>"), ("gdpr_reasoning", "string"), ("recommendation", "string"),
            ("anonymization_strategy", "string"), ("timestamp", "timestamp"), ("analyzer_version", "string"),
            ("line_number", "int"), ("column_number", "int"), ("page_number", "int"),
        )
    )
    schema = f"scan_id string, source string, source_type string, findings array<struct<{fields}>>"
    docs = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = docs.select("scan_id", "source_type", F.posexplode("findings").alias("seq", "f"))
    return rows.select(
        "scan_id", "source_type", "seq", F.col("f.id").alias("finding_id"), F.col("f.timestamp").alias("ts"),
        *[F.col(f"f.{c}") for c in (
            "source", "location", "pii_type", "content", "context", "confidence", "severity", "gdpr_articles",
            "gdpr_reasoning", "recommendation", "anonymization_strategy", "analyzer_version", "line_number",
            "column_number", "page_number")],
    )


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries from JSON lines; blank lines are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).json(path).filter(F.col("event").isNotNull())


def read_audit_days(spark: SparkSession, path: str) -> DataFrame:
    """An audit log written by day: ``day`` and ``batch`` are columns, and ``audit.query`` reads only the days it needs."""
    schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).json(path).filter(F.col("event").isNotNull())


def stream_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT_SCHEMA).json(path).filter(F.col("event").isNotNull())


def read_tables(spark: SparkSession, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of the session's catalog by name."""
    return {n: spark.table(n) for n in names}


def read_jdbc_tables(
    spark: SparkSession, url: str, names: Sequence[str], *, properties: Mapping[str, str] | None = None,
    partitioning: Mapping[str, Mapping[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """Tables of a database. ``partitioning`` gives, per table, ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` for a parallel read; limits and
    filters are pushed to the database."""
    out = {}
    for name in names:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for key, value in {**(properties or {}), **((partitioning or {}).get(name, {}))}.items():
            reader = reader.option(key, value)
        out[name] = reader.load()
    return out
