"""Audit trail and event history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.operators.summary import top_per_group
from velum.session import top_n

# Event names, fields, look-back and caps.
AUDIT_EVENTS = (
    "scan_started", "scan_completed", "scan_failed", "pii_detected", "anonymization", "export",
    "compliance_check", "access_granted", "access_denied", "config_changed",
)
EVENT_TYPES = (
    "scan.started", "scan.completed", "scan.failed", "scan.progress",
    "pii.detected", "pii.batch_detected",
    "anonymization.started", "anonymization.completed",
    "compliance.check_started", "compliance.check_completed", "compliance.violation_detected",
    "export.started", "export.completed",
    "system.plugin_loaded", "system.plugin_unloaded", "system.config_changed",
)
HISTORY_LIMIT = 1000
SUMMARY_HOURS = 24
SUMMARY_READ_LIMIT = 10000

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _text_map(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def entries(
    df: DataFrame, event: str, *, resource: Column, action: Column | str, result: str = "success",
    user: Column | str = "system", ts: Column | None = None, **details: Column,
) -> DataFrame:
    """Audit rows, one per row of ``df``."""

    def lit(v):
        return F.lit(v) if isinstance(v, str) else v

    return df.select(
        (F.current_timestamp() if ts is None else ts).alias("timestamp"),
        F.lit(event).alias("event"),
        lit(user).alias("user"),
        resource.cast("string").alias("resource"),
        lit(action).alias("action"),
        F.lit(result).alias("result"),
        _text_map(**details).alias("details"),
    )


def scan_started(scans: DataFrame, **kw) -> DataFrame:
    return entries(scans, "scan_started", resource=F.col("source"), action="scan", result="started",
                   scan_id=F.col("scan_id"), source_type=F.col("source_type"), **kw)


def scan_completed(scans: DataFrame, **kw) -> DataFrame:
    return entries(scans, "scan_completed", resource=F.col("source"), action="scan", scan_id=F.col("scan_id"),
                   total_findings=F.col("total_findings"), duration_seconds=F.col("duration_seconds"), **kw)


def pii_detected(findings: DataFrame, **kw) -> DataFrame:
    return entries(findings, "pii_detected", resource=F.col("location"), action="detect", scan_id=F.col("scan_id"),
                   pii_type=F.col("pii_type"), severity=F.col("severity"), **kw)


def anonymization(runs: DataFrame, **kw) -> DataFrame:
    return entries(runs, "anonymization", resource=F.col("scan_id"), action="anonymize",
                   strategy=F.col("strategy"), pii_count=F.col("pii_count"), **kw)


def export(exports: DataFrame, **kw) -> DataFrame:
    return entries(exports, "export", resource=F.col("scan_id"), action="export",
                   format=F.col("format"), destination=F.col("destination"), **kw)


def compliance_check(compliance: DataFrame, **kw) -> DataFrame:
    return entries(compliance, "compliance_check", resource=F.col("scan_id"), action="compliance_check",
                   compliance_score=F.col("compliance_score"), total_violations=F.col("total_violations"), **kw)


def access_granted(requests: DataFrame, **kw) -> DataFrame:
    return entries(requests, "access_granted", resource=F.col("resource"), action=F.col("action"), result="granted",
                   user=F.col("user"), **kw)


def access_denied(requests: DataFrame, **kw) -> DataFrame:
    return entries(requests, "access_denied", resource=F.col("resource"), action=F.col("action"), result="denied",
                   user=F.col("user"), reason=F.col("reason"), **kw)


def query(
    log: DataFrame,
    *,
    event: str | None = None,
    user: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    order: Sequence[Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Entries that pass all filters (times inclusive); with a ``limit``, the first ones in log order.

    Filters reach the file scan; of a log written by day only the days in question are read. The limit is a top-k per
    task, not a sort of the log.
    """
    if "day" in log.columns:
        if start is not None:
            log = log.filter(F.col("day") >= F.to_date(start))
        if end is not None:
            log = log.filter(F.col("day") <= F.to_date(end))
    if event is not None:
        log = log.filter(F.col("event") == event)
    if user is not None:
        log = log.filter(F.col("user") == user)
    if start is not None:
        log = log.filter(F.col("timestamp") >= start)
    if end is not None:
        log = log.filter(F.col("timestamp") <= end)
    if limit is None:
        return log
    return top_n(log, order or [F.col("timestamp")], limit)


def summary(log: DataFrame, now: Column | None = None, hours: int = SUMMARY_HOURS, read_limit: int | None = None) -> DataFrame:
    """Counts by event, user and result, and the total, of the last ``hours``; one pass with grouping sets.

    The whole period is counted. ``read_limit=SUMMARY_READ_LIMIT`` restores the behaviour
    of looking at the first 10000 entries only.
    """
    since = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    recent = query(log, start=since, limit=read_limit)
    named = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("event", "user", "result")]
    counts = recent.select(*named).groupBy("event", "user", "result").agg(F.count("*").alias("n"))
    rolled = counts.groupingSets(
        [[], [F.col("event")], [F.col("user")], [F.col("result")]], "event", "user", "result"
    ).agg(F.sum("n").alias("count"), F.grouping_id("event", "user", "result").alias("g"))
    kind = F.when(F.col("g") == 3, "event").when(F.col("g") == 5, "user").when(F.col("g") == 6, "result").otherwise("total")
    return rolled.select(
        kind.alias("kind"), F.coalesce("event", "user", "result", F.lit("all")).alias("key"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def history(
    events: DataFrame, order: Sequence[str], *, last: int, event_type: str | None = None,
    keep: int = HISTORY_LIMIT,
) -> DataFrame:
    """The last ``last`` events (of one type) among the ``keep`` most recent ones, oldest first.

    ``order`` names columns that put events in sequence. Both cuts are top-k queries.
    """
    newest = [F.col(c).desc() for c in order]
    recent = top_n(events, newest, keep)
    if event_type is not None:
        recent = recent.filter(F.col("event_type") == event_type)
    return recent.orderBy(*newest).limit(last).orderBy(*order)


def history_per_type(events: DataFrame, order: Sequence[str], last: int) -> DataFrame:
    """The last ``last`` events of every type, safe when one type dominates."""
    return top_per_group(events, ["event_type"], [F.col(c).desc() for c in order], last)
