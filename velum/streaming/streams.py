"""The batch operators on streams, and the event side of a scan."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velum.functions.patterns import DOCUMENT, Pattern
from velum.operators.detect import detect
from velum.session import exists, remove

log = logging.getLogger(__name__)


def stream_detect(stream: DataFrame, text: str, keep: Sequence[str], patterns: Sequence[Pattern] = DOCUMENT) -> DataFrame:
    """Hits in a stream of texts: the batch operator as it is, without state."""
    return detect(stream, text, keep, patterns)


def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; one without is read in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def event_counts(
    stream: DataFrame, ts: str = "ts", keys: Sequence[str] = ("event_type",), *,
    window: str = "1 day", slide: str | None = None, delay: str = "1 hour",
) -> DataFrame:
    """Events per time window. State is one row per window and key, kept until the watermark passes.

    ``run_to_epochs`` writes open windows as well; ``run_to_table`` only closed ones.
    """
    late = _event_time(stream, ts).withWatermark(ts, delay)
    bucket = F.window(ts, window, slide) if slide else F.window(ts, window)
    return late.groupBy(bucket.alias("w"), *keys).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events"
    )


def drop_duplicates(stream: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First event per correlation id; ids are forgotten once the watermark has passed them."""
    return _event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _event(df: DataFrame, event_type: str, ts: Column | None, origin: str, correlation_id: Column | None, /,
           **data: Column) -> DataFrame:
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(event_type).alias("event_type"),
        (F.current_timestamp() if ts is None else ts).alias("timestamp"),
        F.lit(origin).alias("source"),
        F.create_map(*pairs).alias("data"),
        (F.lit(None) if correlation_id is None else correlation_id).cast("string").alias("correlation_id"),
    )


def scan_started_events(scans: DataFrame, ts: Column | None = None, source: str = "system",
                        correlation_id: Column | None = None) -> DataFrame:
    return _event(scans, "scan.started", ts, source, correlation_id, scan_id=F.col("scan_id"),
                  source=F.col("source"), source_type=F.col("source_type"))


def scan_completed_events(scans: DataFrame, ts: Column | None = None, source: str = "system",
                          correlation_id: Column | None = None) -> DataFrame:
    return _event(scans, "scan.completed", ts, source, correlation_id, scan_id=F.col("scan_id"),
                  total_findings=F.col("total_findings"), duration_seconds=F.col("duration_seconds"))


def pii_detected_events(findings: DataFrame, ts: Column | None = None, source: str = "system",
                        correlation_id: Column | None = None) -> DataFrame:
    return _event(findings, "pii.detected", ts, source, correlation_id, scan_id=F.col("scan_id"),
                  pii_type=F.col("pii_type"), location=F.col("location"), severity=F.col("severity"),
                  confidence=F.col("confidence"))


def violation_events(violations: DataFrame, ts: Column | None = None, source: str = "system",
                     correlation_id: Column | None = None) -> DataFrame:
    return _event(violations, "compliance.violation_detected", ts, source, correlation_id,
                  scan_id=F.col("scan_id"), rule_id=F.col("rule_id"), article=F.col("article"),
                  severity=F.col("severity"), description=F.col("description"))


Handler = Callable[[DataFrame, int], None]


def route(subscribers: Mapping[str, Sequence[Handler]], type_column: str = "event_type") -> Handler:
    """A ``foreachBatch`` function that hands each subscriber the events of its type.

    A handler that fails is logged and does not stop the others.
    """

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for event_type, handlers in subscribers.items():
                events = batch.filter(F.col(type_column) == event_type)
                for handler in handlers:
                    try:
                        handler(events, epoch)
                    except Exception:
                        log.exception("handler for %s failed in batch %s", event_type, epoch)
        finally:
            batch.unpersist()

    return deliver


#: Subscribers by name: the type of event they want, and their handler.
Subscribers = Mapping[str, tuple[str, Handler]]


def route_durably(subscribers: Subscribers, dead: str, type_column: str = "event_type") -> Handler:
    """As ``route``, but what a failed handler missed is kept below ``dead``, with the reason, for ``replay``.

    There is one folder a subscriber and batch. A batch that is delivered again replaces its folder, or removes it where the handler
    now succeeds, so the table holds exactly what is still missing.
    """

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for name, (event_type, handler) in subscribers.items():
                _try_to_deliver(batch.filter(F.col(type_column) == event_type), epoch, name, handler, dead)
        finally:
            batch.unpersist()

    return deliver


def _letters(dead: str, name: str, epoch: int) -> str:
    return f"{dead}/subscriber={name}/epoch={epoch}"


def _try_to_deliver(events: DataFrame, epoch: int, name: str, handler: Handler, dead: str, replayed: bool = False) -> bool:
    place = _letters(dead, name, epoch)
    try:
        handler(events, epoch)
    except Exception as e:
        log.warning("subscriber %s failed in batch %s", name, epoch, exc_info=True)
        if not replayed:  # what is replayed is there already
            events.withColumn("reason", F.lit(f"{type(e).__name__}: {e}")).write.mode("overwrite").parquet(place)
        return False
    remove(events.sparkSession, place)
    return True


def dead_letters(spark: SparkSession, dead: str, schema: str) -> DataFrame:
    """What subscribers missed: events of ``schema`` with ``reason``, ``subscriber`` and ``epoch``."""
    whole = f"{schema}, reason string, subscriber string, epoch int"
    return spark.read.schema(whole).parquet(dead) if exists(spark, dead) else spark.createDataFrame([], whole)


def replay(spark: SparkSession, subscribers: Subscribers, dead: str, schema: str) -> int:
    """Hand each subscriber just what it missed, batch by batch in order; what succeeds leaves the table.

    Handlers see the number of the batch as at first, so writers by batch do not write twice. Returns how many
    batches are still missing; those of unknown subscribers stay.
    """
    # One row a failed batch and subscriber.
    missed = dead_letters(spark, dead, schema).select("subscriber", "epoch").distinct().orderBy("subscriber", "epoch").collect()
    left = 0
    for row in missed:
        known = subscribers.get(row.subscriber)
        events = spark.read.schema(schema).parquet(_letters(dead, row.subscriber, row.epoch)) if known else None
        left += not (known and _try_to_deliver(events, row.epoch, row.subscriber, known[1], dead, replayed=True))
    return left


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into Parquet files and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def epoch_writer(path: str) -> Handler:
    """A handler that writes each batch to a folder of its own, so a batch that is delivered again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_to_epochs(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process everything available, each batch into a folder of its own, and stop.

    In update mode the sink gets every group that a batch has changed, also windows that are still open;
    ``latest`` reads the last state of each.
    """
    return (
        stream.writeStream.foreachBatch(epoch_writer(path))
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def latest(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state of each group in a table of epochs; combined before the shuffle."""
    rest = [c for c in written.columns if c not in (*keys, "epoch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])
