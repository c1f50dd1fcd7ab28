"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default: all) choose data and cores;
``BENCH_QUERIES=all`` or a comma list runs other registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pii_counts_by_type_severity",
    "pii_spans_base",
    "pii_spans_all",
    "secrets_custom_patterns",
    "sensitive_topics",
    "validated_ids",
    "redact_text",
    "type_cooccurrence",
    "gdpr_violations",
    "compliance_score",
    "top_recommendations",
    "scan_diff",
    "anonymize_by_value",
    "anonymize_by_span",
    "column_profile",
    "page_text",
    "page_links",
    "page_pii",
    "audit_summary",
    "stream_detect",
    "stream_event_counts",
    "enrich_stub",
)


def python_scan(spark, sf_dir):
    """The same search as ``pii_spans_all`` in one pass of Python's ``re``, for comparison."""
    import re

    import pandas as pd

    from velum.functions.patterns import DOCUMENT
    from velum.plans.registry import table
    from velum.session import spread

    compiled = [(p.pii_type, p.entity, p.confidence, re.compile(p.java_regex)) for p in DOCUMENT]

    def run(frames):
        for frame in frames:
            rows = [
                (key, kind, entity, m.start(), m.end(), m.group(), score)
                for key, text in zip(frame["doc_id"], frame["text"])
                for kind, entity, score, regex in compiled
                for m in regex.finditer(text)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "entity_type", "start", "end", "value", "confidence"])

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.mapInPandas(
        run, "doc_id long, pii_type string, entity_type string, start int, end int, value string, confidence double")


def main() -> None:
    from velum.plans import QUERIES
    from velum.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else list(HEADLINE)
    spark = local_session(cpus, "velum-bench")
    # Start executors, code generation and the Python workers before the clock.
    QUERIES["pii_spans_base"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        # A noop write computes every column of every row; count() would prune them.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    if os.environ.get("BENCH_PYTHON"):
        start = time.perf_counter()
        python_scan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"python scan: {time.perf_counter() - start:.3f}", file=sys.stderr)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
