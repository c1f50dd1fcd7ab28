"""Running totals of scans on a stream of findings, in keyed state.

Each finding moves the totals of its scan once, however often it is delivered: repeated ids are dropped within the delay. The state of a
scan is a map of counts per type, severity and kind of source, so it stays small whatever the number of findings, and it
expires when the watermark is ``idle`` past the scan's last finding. Every batch puts out the counts that changed, and the score follows from counts alone, by the
same rules as in a batch.

A scan that holds most of the stream is dealt over ``slices`` by the hash of the finding's id, so no task meets a whole
scan; slices are summed when the totals are read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from velum.operators.compliance import RULES, Rule, compliance_of_counts
from velum.streaming.streams import drop_duplicates, latest, run_to_epochs

CELL = ("pii_type", "severity", "source_type")
SCHEMA = "scan_id string, slice int, pii_type string, severity string, source_type string, n long"


def running_counts(findings: DataFrame, ts: str = "ts", *, delay: str = "1 day", idle: str = "7 days", slices: int = 16) -> DataFrame:
    """Changed counts ``(scan_id, slice, pii_type, severity, source_type, n)`` of each batch, for append mode.

    Findings may come in any order, up to ``delay`` late; later ones are left out. Null ids, types and the like count as empty.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def counted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counts = Counter({tuple(cell): n for *cell, n in json.loads(state.get[0])} if state.exists else {})
        changed, last = set(), state.getCurrentWatermarkMs()
        for frame in frames:
            last = max(last, int(frame[ts].max().timestamp() * 1000))
            for cell, n in frame.groupby(list(CELL)).size().items():
                counts[cell] += int(n)
                changed.add(cell)
        state.update((json.dumps([[*cell, n] for cell, n in counts.items()]),))
        state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame([(*key, *cell, counts[cell]) for cell in sorted(changed)], columns=["scan_id", "slice", *CELL, "n"])

    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("scan_id", "finding_id", *CELL)}
    once = drop_duplicates(findings.select(*text.values(), ts), "finding_id", ts, delay)
    dealt = once.withColumn("slice", F.pmod(F.xxhash64("finding_id"), F.lit(slices)).cast("int"))
    return dealt.groupBy("scan_id", "slice").applyInPandasWithState(counted, SCHEMA, "counts string", "append", GroupStateTimeout.EventTimeTimeout)


def run_totals(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available, each batch into a folder of its own that a repeated delivery overwrites, and stop."""
    return run_to_epochs(counts, path, checkpoint, "append")


def current_counts(written: DataFrame) -> DataFrame:
    """``(scan_id, pii_type, severity, source_type, n)`` from the table of epochs: the last count of each slice, summed."""
    last = latest(written, ["scan_id", "slice", *CELL])
    return last.groupBy("scan_id", *CELL).agg(F.sum("n").alias("n"))


def current_totals(written: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per scan: number of findings, maps by severity and by type, score and status."""
    cells = current_counts(written)

    def counted(column: str, name: str) -> DataFrame:
        per = cells.groupBy("scan_id", column).agg(F.sum("n").alias("n"))
        pairs = F.array_sort(F.collect_list(F.struct(column, "n")))  # one a severity or type
        return per.groupBy("scan_id").agg(F.map_from_entries(pairs).alias(name), F.sum("n").alias("total_findings"))

    scored = compliance_of_counts(cells.drop("severity"), rules)
    totals = counted("severity", "by_severity").join(counted("pii_type", "by_type").drop("total_findings"), "scan_id")
    return totals.join(scored, "scan_id", "left").withColumns({
        "compliance_score": F.coalesce("compliance_score", F.lit(100.0)), "status": F.coalesce("status", F.lit("compliant"))})
