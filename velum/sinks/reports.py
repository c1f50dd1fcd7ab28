"""Exports: CSV rows, sheets, summaries, saved scans, audit lines, text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.text import fixed
from velum.operators import summary
from velum.operators.diff import DEFAULT_KEYS, last_per_signature, signature_digest
from velum.operators.findings import redacted

# Fixed value: how much of a context goes into an export.
CONTEXT_LIMIT = 100


def _cut(context: Column, dots: bool) -> Column:
    head = F.left(context, F.lit(CONTEXT_LIMIT))
    return F.when(F.length(context) > CONTEXT_LIMIT, F.concat(head, F.lit("..."))).otherwise(context) if dots else head


def _number(value: Column) -> Column:
    """Empty for null and 0."""
    return F.when(value.isNull() | (value == 0), "").otherwise(value.cast("string"))


def _iso(ts: Column) -> Column:
    """ISO 8601; the fraction only where there is one."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def csv_rows(findings: DataFrame) -> DataFrame:
    """The twelve columns of the CSV export, all as text."""
    return findings.select(
        F.col("finding_id").alias("id"),
        "source",
        "location",
        "pii_type",
        _cut(F.col("context"), dots=True).alias("context"),
        fixed(F.col("confidence")).alias("confidence"),
        "severity",
        F.array_join("gdpr_articles", ", ").alias("gdpr_articles"),
        "recommendation",
        F.coalesce(_iso(F.col("ts")), F.lit("")).alias("timestamp"),
        _number(F.col("line_number")).alias("line_number"),
        _number(F.col("page_number")).alias("page_number"),
    )


def sheet_rows(findings: DataFrame) -> DataFrame:
    """The findings sheet of a workbook: nine columns, context cut without dots."""
    return findings.select(
        F.col("finding_id").alias("ID"),
        F.col("source").alias("Source"),
        F.col("location").alias("Location"),
        F.col("pii_type").alias("PII Type"),
        F.col("severity").alias("Severity"),
        fixed(F.col("confidence")).alias("Confidence"),
        _cut(F.col("context"), dots=False).alias("Context"),
        F.array_join("gdpr_articles", ", ").alias("GDPR Articles"),
        F.col("recommendation").alias("Recommendation"),
    )


def summary_rows(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Sections of the summary table: scan facts, by severity (alphabetical), by type (most first)."""
    sev = summary.by_severity(findings).select(
        F.lit(2).alias("section"), F.col("severity").alias("key"), F.col("count").cast("string").alias("value"),
        F.lit(0).cast("long").alias("rank"),
    )
    kind = summary.by_type(findings).select(
        F.lit(3).alias("section"), F.col("pii_type").alias("key"), F.col("count").cast("string").alias("value"),
        (-F.col("count")).alias("rank"),
    )
    out = sev.unionByName(kind)
    if scans is not None:
        facts = scans.select(
            F.lit(1).alias("section"),
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(label).alias("key"), value.cast("string").alias("value"), F.lit(i).cast("long").alias("rank"))
                        for i, (label, value) in enumerate(
                            (
                                ("Source", F.col("source")),
                                ("Type", F.col("source_type")),
                                ("Status", F.col("status")),
                                ("Duration (seconds)", fixed(F.col("duration_seconds"))),
                                ("Total Findings", F.col("total_findings")),
                            )
                        )
                    ]
                )
            ),
        )
        out = facts.unionByName(out)
    return out.orderBy("section", "rank", "key")


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_workbook(findings: DataFrame, scans: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The four sheets of the workbook export as four CSV folders."""
    write_csv(summary_rows(findings, scans), f"{path}/summary", mode)
    write_csv(sheet_rows(findings), f"{path}/findings", mode)
    write_csv(summary.by_severity(findings).orderBy("severity"), f"{path}/by_severity", mode)
    write_csv(summary.type_table(findings), f"{path}/by_type", mode)


def save_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Findings as JSON lines, with every detected value hidden."""
    redacted(findings).write.mode(mode).json(path)


def store_signatures(
    findings: DataFrame, name: str, path: str, *, order: Column, keys: Sequence[str] = DEFAULT_KEYS, buckets: int = 64, salt: str = ""
) -> None:
    """The last finding of each signature as a table of the catalog at ``path``, bucketed and sorted by a digest of its keys.

    The table has no detected value. Scans that are to be compared need the same keys and salt, and for a join without a shuffle
    as many buckets. A name that exists is an error.
    """
    last = last_per_signature(findings, order, keys)
    rows = last.select(signature_digest(keys, salt), "pii_type", "severity", "confidence")
    rows.repartition(buckets, "signature").write.bucketBy(buckets, "signature").sortBy("signature").option("path", path).saveAsTable(name)


def audit_lines(entries: DataFrame, *keep: str) -> DataFrame:
    """Audit rows as JSON text, one ``value`` per entry; absent fields stay visible as null."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    return entries.select(
        *keep,
        F.to_json(
            F.struct(stamp, "event", "user", "resource", "action", "result", "details"), {"ignoreNullFields": "false"}
        ).alias("value")
    )


def append_audit(entries: DataFrame, path: str) -> None:
    audit_lines(entries).write.mode("append").text(path)


def write_audit_days(entries: DataFrame, path: str, batch: str) -> None:
    """Audit lines below ``day=…/batch=…``. A batch that is written again replaces its own files and no others."""
    stamped = entries.select(F.to_date("timestamp").alias("day"), F.lit(batch).alias("batch"), "*")
    lines = audit_lines(stamped, "day", "batch")
    lines.write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Report lines in order. The sort is by range, so a long report is several files that follow each other."""
    lines.orderBy("section", "sort_key", "part").select("line").write.mode(mode).text(path)


def write_compliance_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.write.mode(mode).json(path)
