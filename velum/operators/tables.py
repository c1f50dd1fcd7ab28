"""Scanning tables: column names, column contents, schema checks, samples, rows as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import grading
from velum.functions.patterns import DOCUMENT, Pattern
from velum.functions.text import fixed
from velum.operators.detect import with_gates
from velum.operators.findings import conform, finding_id, merge
from velum.session import materialize, spread, top_n

# Column-name fragments, first match wins, with type and severity.
COLUMN_HINTS = (
    ("email", "EMAIL", "medium"),
    ("phone", "PHONE_NUMBER", "medium"),
    ("ssn", "SSN", "critical"),
    ("social_security", "SSN", "critical"),
    ("password", "OTHER", "critical"),
    ("credit_card", "CREDIT_CARD", "critical"),
    ("card_number", "CREDIT_CARD", "critical"),
    ("dob", "DATE_OF_BIRTH", "high"),
    ("birth_date", "DATE_OF_BIRTH", "high"),
    ("address", "LOCATION", "medium"),
    ("salary", "OTHER", "high"),
    ("income", "OTHER", "high"),
    ("passport", "PASSPORT", "critical"),
    ("license", "DRIVER_LICENSE", "high"),
    ("tax_id", "OTHER", "critical"),
    ("medical", "MEDICAL_LICENSE", "critical"),
    ("health", "MEDICAL_LICENSE", "critical"),
)
AUDIT_WORDS = ("audit", "log", "history", "changelog")
NAME_CONFIDENCE, CONTENT_CONFIDENCE, REPORT_FROM_PERCENT = 0.75, 0.85, 5.0
DEFAULT_SAMPLE = 1000


def _as_findings(df: DataFrame, **fields: Column) -> DataFrame:
    out = df.withColumns(fields)
    return conform(
        out.withColumns(
            {
                "scan_id": F.col("source"),
                "source_type": F.lit("database"),
                "finding_id": finding_id(F.col("source"), F.col("location"), F.col("pii_type"), F.col("content")),
            }
        )
    )


def column_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, column_name, data_type)`` of the given tables: schemas only, no data is read."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def hint_for_name(name: Column) -> Column:
    """``struct(pii_type, severity)`` suggested by a column name, or null."""
    low, out = F.lower(name), None
    for word, kind, sev in COLUMN_HINTS:
        hint = F.struct(F.lit(kind).alias("pii_type"), F.lit(sev).alias("severity"))
        out = F.when(low.contains(word), hint) if out is None else out.when(low.contains(word), hint)
    return out


def scan_column_names(columns: DataFrame, source: Column) -> DataFrame:
    """Findings for suspicious column names in ``(table_name, column_name, data_type)`` rows."""
    place = F.concat_ws(".", "table_name", "column_name")
    hinted = columns.withColumn("hint", hint_for_name(F.col("column_name"))).filter(F.col("hint").isNotNull())
    kind = F.col("hint.pii_type")
    return _as_findings(
        hinted,
        source=source,
        location=place,
        pii_type=kind,
        content=F.format_string("Column: %s (type: %s)", "column_name", "data_type"),
        context=F.concat(F.lit("Table column with potential PII: "), F.col("column_name")),
        confidence=F.lit(NAME_CONFIDENCE),
        severity=F.col("hint.severity"),
        gdpr_articles=grading.articles(kind, "database"),
        recommendation=F.concat(F.lit("Check whether "), place, F.lit(" holds personal data; encrypt and restrict it.")),
    )


def sample(
    df: DataFrame,
    key: str,
    rows: int = DEFAULT_SAMPLE,
    *,
    strategy: str = "random",
    seed: int = 42,
    fraction: float | None = None,
) -> DataFrame:
    """At most ``rows`` rows: the ``top`` or ``bottom`` by ``key``, or a reproducible random choice.

    All three are top-k queries: every task keeps ``rows`` candidates and no full sort
    takes place. ``fraction`` (clamped to 0..1) thins the table first.
    """
    if fraction is not None:
        df = df.sample(min(max(fraction, 0.0), 1.0), seed)
    order = {
        "top": [F.col(key).asc()],
        "bottom": [F.col(key).desc()],
        "random": [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)],
    }[strategy]
    return top_n(df, order, rows)


def profile_columns(
    df: DataFrame, table_name: str, columns: Sequence[str] | None = None, patterns: Sequence[Pattern] = DOCUMENT
) -> DataFrame:
    """Per column and type: values, hits, and hits per hundred values of one table."""
    return profile_tables({table_name: df.select(*columns) if columns else df}, patterns)


def profile_tables(tables: Mapping[str, DataFrame], patterns: Sequence[Pattern] = DOCUMENT) -> DataFrame:
    """Column profiles of any number of tables with a single aggregate.

    Every value is looked at on its own. Columns are unpivoted inside the scan and
    counted before the shuffle, so only one row per task, column and type moves.
    """
    long = None
    for name, df in tables.items():
        cells = spread(df).select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        rows = cells.unpivot([], df.columns, "column_name", "v").filter(F.col("v").isNotNull())
        rows = rows.select(F.lit(name).alias("table_name"), "column_name", "v")
        long = rows if long is None else long.unionByName(rows)
    gated, gates = with_gates(long, "v", patterns)
    types = list(dict.fromkeys(p.pii_type for p in patterns))
    hits = {t: F.lit(0) for t in types}
    for p in patterns:
        found = F.regexp_count("v", F.lit(p.java_regex))
        hits[p.pii_type] = hits[p.pii_type] + (
            F.when(F.col(gates[p.gate]), found).otherwise(0) if p.gate else found
        )
    counted = gated.groupBy("table_name", "column_name").agg(
        F.count("*").alias("values"), *[F.sum(c).alias(t) for t, c in hits.items()]
    )
    tall = counted.unpivot(["table_name", "column_name", "values"], types, "pii_type", "hits").filter(F.col("hits") > 0)
    return tall.select(
        "table_name", "column_name", "pii_type", "hits", "values",
        (F.col("hits") / F.col("values") * 100).alias("percent"),
    )


def scan_column_contents(profile: DataFrame, source: Column) -> DataFrame:
    """Findings for columns in which a type reaches five hits per hundred values."""
    place, kind = F.concat_ws(".", "table_name", "column_name"), F.col("pii_type")
    frequent = profile.filter(F.col("percent") >= REPORT_FROM_PERCENT)
    return _as_findings(
        frequent,
        source=source,
        location=place,
        content=F.concat(
            F.lit("Column contains "), kind, F.lit(" in ~"), fixed(F.col("percent"), 1), F.lit("% of sampled rows")),
        context=F.format_string("Detected %d instances of %s in %d samples", "hits", "pii_type", "values"),
        confidence=F.lit(CONTENT_CONFIDENCE),
        severity=grading.severity(kind, None, "database"),
        gdpr_articles=grading.articles(kind, "database"),
        recommendation=F.concat(F.lit("Protect "), place, F.lit(": encrypt, restrict access, set a retention period.")),
    )


def _schema_finding(base: DataFrame, source: Column, content: str, context: str, confidence: float,
                    articles: Sequence[str], advice: str) -> DataFrame:
    return _as_findings(
        base,
        source=source,
        location=F.lit("database_schema"),
        pii_type=F.lit("OTHER"),
        content=F.lit(content),
        context=F.lit(context),
        confidence=F.lit(confidence),
        severity=F.lit("medium"),
        gdpr_articles=F.array(*[F.lit(a) for a in articles]),
        recommendation=F.lit(advice),
    )


def check_encryption(databases: DataFrame, source: Column) -> DataFrame:
    """One reminder per database: encryption cannot be seen from its schema."""
    return _schema_finding(
        databases, source, "Database encryption configuration", "Database-level security review", 0.60, ["Art. 32"],
        "Check that the database encrypts data at rest and in transit.",
    )


def check_audit_tables(tables: DataFrame, table_name: str = "table_name", keys: Sequence[str] = ()) -> DataFrame:
    """Keys (databases) whose table names show no audit trail. Without keys, one row for all
    tables, also when there are none."""
    has_audit = F.coalesce(F.bool_or(F.lower(F.col(table_name)).rlike("|".join(AUDIT_WORDS))), F.lit(False))
    return tables.groupBy(*keys).agg(has_audit.alias("has_audit")).filter(~F.col("has_audit")).drop("has_audit")


def audit_findings(missing: DataFrame, source: Column) -> DataFrame:
    return _schema_finding(
        missing, source, "No audit tables detected", "Database schema analysis", 0.70, ["Art. 5", "Art. 32"],
        "Record who reads and changes personal data, in audit tables.",
    )


def scan_database(
    tables: Mapping[str, DataFrame],
    source: str,
    keys: Mapping[str, str],
    *,
    rows: int | None = None,
    patterns: Sequence[Pattern] = DOCUMENT,
) -> DataFrame:
    """All findings of a database: names, contents and schema of each table, as one lazy plan.

    Whole tables are scanned. With ``rows`` only a sample of each is, ordered by the column that ``keys`` names.
    """
    src = F.lit(source)
    bodies = {name: df if rows is None else sample(df, keys[name], rows) for name, df in tables.items()}
    parts = [
        scan_column_names(column_catalog(tables), src),
        scan_column_contents(profile_tables(bodies, patterns), src),
    ]
    names = column_catalog(tables).select("table_name").distinct()
    one = names.agg(F.count("*").alias("tables"))
    parts.append(check_encryption(one, src))
    parts.append(audit_findings(check_audit_tables(names), src))
    return merge(*parts)


def rows_as_text(df: DataFrame, columns: Sequence[str], *, structured: bool = False, row_number: str | None = None) -> DataFrame:
    """Each row as one line: cells joined by tabs, or ``Row n: header: value | …``.

    A sheet of any length stays distributed: lines are rows, ordered by ``row_number``
    (1-based data row; the header is line 1, so data starts at ``Row 2``).
    """
    cells = [F.trim(F.col(c).cast("string")) for c in columns]
    filled = [F.when(F.length(v) > 0, v) for v in cells]
    keep = [row_number] if row_number else []
    if not structured:
        line = F.concat_ws("\t", *filled)
        return df.select(*keep, line.alias("line")).filter(F.col("line") != "")
    named = [F.concat(F.lit(f"{c}: "), v) for c, v in zip(columns, filled)]
    body = F.concat_ws(" | ", *named)
    prefix = F.concat(F.lit("Row "), (F.col(row_number) + 1).cast("string"), F.lit(": "))
    return df.select(*keep, body.alias("body")).filter(F.col("body") != "").select(
        *keep, F.concat(prefix, F.col("body")).alias("line")
    )


def header_line(columns: Sequence[str]) -> str:
    return "Headers: " + ", ".join(columns)


def sheet_text(lines: DataFrame, columns: Sequence[str], row_number: str, keys: Sequence[str] = (), *, structured: bool = False) -> DataFrame:
    """Sheets as one text each: the rows of ``rows_as_text``, in order, below the line of headers if ``structured``.

    A text is one value, so a sheet must fit into one; longer tables are scanned row by row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(row_number).alias("n"), F.col("line").alias("line"))))
    body = lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    return body.withColumn("text", F.concat(F.lit(header_line(columns) + "\n"), "text")) if structured else body


def number_rows(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Consecutive row numbers (``row_number``, from 1) in the order of a unique ``key``.

    The table is cut into value ranges of similar size and written with the number of
    its range, which fixes the cut. Rows are then counted per range and numbered within
    it, so no task sorts the whole table.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(n, key).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    # This window has no partitions, but only one row per range.
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    numbered = cut.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")  # ``n`` rows
    return numbered.withColumn("row_number", F.col("__inside") + F.col("__before")).drop("__range", "__inside", "__before")
