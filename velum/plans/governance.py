"""Registered queries: rules and score, comparison of scans, anonymisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from velum.functions import masking
from velum.functions.patterns import BASE, DOCUMENT
from velum.operators import anonymize as A
from velum.operators import compliance as C
from velum.operators import detect as D
from velum.operators import diff as X
from velum.operators import findings as FN
from velum.plans import sqlkit as K
from velum.plans.corpus import CONTACTS_SQL, SCANS_SQL, contacts, document_findings, later_findings, scans
from velum.plans.registry import query, table
from velum.session import materialize, scratch_dir
from velum.sinks import reports as R
from velum.sources import saved
from velum.streaming import streams as ST

# --- rules ---------------------------------------------------------------------------------


def _listed(values) -> str:
    return "NULL" if values is None else "[" + ", ".join(K.text(v) for v in values) + "]"


def _rule_rows() -> str:
    return ", ".join(
        f"({i}, {K.text(r.id)}, {K.text(r.article)}, {K.text(r.severity)}, {K.text(r.recommendation)}, {K.text(r.name)}, "
        f"{K.text(r.description)}, {_listed(r.pii_types)}, {str(r.any_pii).lower()}, {_listed(r.source_types)}, "
        f"{r.threshold_count or 'NULL'})"
        for i, r in enumerate(C.RULES)
    )


VIOLATIONS_SQL = f"""{K.DOC_FINDINGS},
rules(rule_seq, rule_id, article, severity, recommendation, rule_name, description, pii_types, any_pii, source_types, threshold)
  AS (VALUES {_rule_rows()}),
counted AS (SELECT *, count(*) OVER (PARTITION BY scan_id, pii_type) AS type_count FROM findings),
violations AS (SELECT f.scan_id, f.finding_id, f.location AS finding_location, f.source, f.pii_type, f.doc_id, f.seq,
  r.rule_seq, r.rule_id, r.rule_name, r.article, r.description, r.severity, r.recommendation
  FROM counted f JOIN rules r ON (r.pii_types IS NULL OR list_contains(r.pii_types, f.pii_type))
   AND (r.any_pii OR ((r.source_types IS NULL OR list_contains(r.source_types, 'document'))
     AND (r.threshold IS NULL OR f.type_count >= r.threshold))))"""

SCORE_SQL = f"""{VIOLATIONS_SQL}, {SCANS_SQL},
points AS (SELECT scan_id, count(*) AS n,
  sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END) AS p,
  count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM violations GROUP BY scan_id),
score AS (SELECT scan_id, CAST(greatest(0, 100 - coalesce(p, 0)) AS DOUBLE) AS compliance_score,
  coalesce(n, 0) AS total_violations, coalesce(c, 0) AS critical_issues, coalesce(h, 0) AS high_issues
  FROM scans LEFT JOIN points USING (scan_id)),
compliance AS (SELECT scan_id, compliance_score, CASE WHEN critical_issues > 0 THEN 'non_compliant'
  WHEN compliance_score >= 90 THEN 'compliant' WHEN compliance_score >= 70 THEN 'mostly_compliant'
  ELSE 'needs_improvement' END AS status, total_violations, critical_issues, high_issues FROM score)"""


@query(
    "gdpr_violations",
    f"""WITH {VIOLATIONS_SQL} SELECT scan_id, finding_id, finding_location, source, pii_type, CAST(rule_seq AS INTEGER) AS rule_seq,
  rule_id, rule_name, article, description, severity, recommendation FROM violations""",
)
def gdpr_violations(spark, sf_dir):
    # Read for the counts and again for the rules, so the detection is written once.
    return C.violations(materialize(document_findings(spark, sf_dir).drop("content", "context"), "findings"))


@query("compliance_score", f"WITH {SCORE_SQL} SELECT * FROM compliance")
def compliance_score(spark, sf_dir):
    return C.compliance(document_findings(spark, sf_dir), scans=scans(spark, sf_dir))


@query("violations_by_article", f"WITH {VIOLATIONS_SQL} SELECT scan_id, article, count(*) AS violations FROM violations GROUP BY ALL")
def violations_by_article(spark, sf_dir):
    return C.by_article(document_findings(spark, sf_dir))


@query(
    "critical_violations",
    f"WITH {VIOLATIONS_SQL} SELECT scan_id, finding_id, rule_id, article FROM violations WHERE severity = 'critical'",
)
def critical_violations(spark, sf_dir):
    found = C.violations(materialize(document_findings(spark, sf_dir).drop("content", "context"), "findings"))
    return C.with_severity(found, "critical").select("scan_id", "finding_id", "rule_id", "article")


@query(
    "top_recommendations",
    f"""WITH {VIOLATIONS_SQL},
per AS (SELECT scan_id, recommendation, count(*) AS n, arg_min(severity, [doc_id, seq, rule_seq]) AS severity,
  min([doc_id, seq, rule_seq]) AS seen FROM violations GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, n DESC, seen) AS rank FROM per),
heads AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM violations GROUP BY scan_id)
SELECT scan_id, CAST(rank AS INTEGER) AS rank, recommendation || CASE WHEN n > 1 THEN ' (affects ' || n || ' items)' ELSE '' END AS line
  FROM ranked WHERE rank <= 10
UNION ALL SELECT scan_id, -1, 'URGENT: Address ' || c || ' critical violations immediately' FROM heads WHERE c > 0
UNION ALL SELECT scan_id, 0, 'HIGH PRIORITY: Resolve ' || h || ' high-severity issues within 30 days' FROM heads WHERE h > 0""",
)
def top_recommendations(spark, sf_dir):
    order = F.struct(F.col("source").cast("long").alias("doc"), "seq")
    return C.recommendations(document_findings(spark, sf_dir), order, top=10)


@query(
    "type_count_in_scan",
    f"""WITH {K.DOC_FINDINGS} SELECT finding_id, scan_id, pii_type, count(*) OVER (PARTITION BY scan_id, pii_type) AS type_count FROM findings""",
)
def type_count_in_scan(spark, sf_dir):
    found = materialize(document_findings(spark, sf_dir).drop("content", "context"), "findings")
    return FN.with_type_count(found).select("finding_id", "scan_id", "pii_type", "type_count")


@query(
    "article_details",
    f"""WITH {K.DOC_FINDINGS}, a AS (SELECT unnest(string_split(gdpr_articles, ', ')) AS article FROM findings),
info(article, article_name, key_points) AS (VALUES {', '.join(f"({K.text(k)}, {K.text(n)}, {K.text('; '.join(p))})" for k, (n, p) in C.ARTICLES.items())})
SELECT article, count(*) AS findings, any_value(article_name) AS article_name, any_value(key_points) AS key_points
FROM a LEFT JOIN info USING (article) GROUP BY article""",
)
def article_details(spark, sf_dir):
    named = document_findings(spark, sf_dir).select(F.explode("gdpr_articles").alias("article"))
    counted = named.groupBy("article").agg(F.count("*").alias("findings"))
    return C.article_details(counted, "article").withColumn("key_points", F.array_join("key_points", "; "))


@query(
    "compliance_report",
    f"""WITH {SCORE_SQL} SELECT s.scan_id, s.source, s.source_type, c.compliance_score, c.status AS compliance_status, c.total_violations,
  c.critical_issues, c.high_issues, '2024-02-01 00:00:00' AS generated FROM scans s LEFT JOIN compliance c USING (scan_id)""",
)
def compliance_report(spark, sf_dir):
    every = scans(spark, sf_dir).select("scan_id", "source", "source_type")
    score = C.compliance(document_findings(spark, sf_dir), scans=every).withColumnRenamed("status", "compliance_status")
    return C.compliance_report(every, score, F.lit("2024-02-01 00:00:00"))


# --- comparison ----------------------------------------------------------------------------

KEYS = ("source", "location", "pii_type", "content")


def _later_sql() -> str:
    patterns = [p for p in BASE]
    spans = K.spans("edited", ["doc_id", "source"], patterns).replace("__", "__b").replace("spans AS", "later_spans AS")
    return f"""edited AS (SELECT doc_id, source, translate(text, '0@', '8#') || CASE WHEN source = 'src1' THEN chr(10) || 'SSN 123-45-6789' ELSE '' END AS text FROM documents), {spans},
later AS (SELECT source AS scan_id, doc_id, CAST(doc_id AS VARCHAR) AS source, 'Document' AS location, seq, pii_type,
  value AS content, context, start, "end", CASE WHEN pii_type = 'IP_ADDRESS' THEN 0.95 ELSE confidence END AS confidence,
  {K.DOCUMENT_SEVERITY} AS severity FROM later_spans)"""


DIFF_SQL = f"""{K.DOC_FINDINGS}, {_later_sql()},
old AS (SELECT source, location, pii_type, left(content, 50) AS content, arg_max(severity, [doc_id, seq]) AS baseline_severity,
  arg_max(confidence, [doc_id, seq]) AS baseline_confidence, true AS in_old FROM findings GROUP BY ALL),
new AS (SELECT source, location, pii_type, left(content, 50) AS content, arg_max(severity, [doc_id, seq]) AS current_severity,
  arg_max(confidence, [doc_id, seq]) AS current_confidence, true AS in_new FROM later GROUP BY ALL),
diff AS (SELECT source, location, pii_type, content, baseline_severity, baseline_confidence, current_severity, current_confidence,
  CASE WHEN in_old IS NULL THEN 'new' WHEN in_new IS NULL THEN 'resolved'
    WHEN baseline_severity <> current_severity OR baseline_confidence <> current_confidence THEN 'modified' ELSE 'unchanged' END AS change_type
  FROM old FULL JOIN new USING (source, location, pii_type, content))"""

_ORDER = ("source", "seq")


def _order():
    return F.struct(F.col("source").cast("long").alias("doc"), "seq")


def _diff(spark, sf_dir, keys=KEYS):
    return X.compare(document_findings(spark, sf_dir), later_findings(spark, sf_dir), order=_order(), keys=keys)


@query("scan_diff", f"WITH {DIFF_SQL} SELECT * FROM diff")
def scan_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


_DIGEST_SQL = "sha256(" + " || ".join(f"coalesce(length({k}) || ':' || {k}, '-')" for k in KEYS) + ")"


@query(
    "scan_diff_stored",
    f"""WITH {DIFF_SQL} SELECT {_DIGEST_SQL} AS signature, pii_type, baseline_severity, baseline_confidence,
  current_severity, current_confidence, change_type FROM diff""",
)
def scan_diff_stored(spark, sf_dir):
    kept = []
    for label, found in (("baseline", document_findings(spark, sf_dir)), ("current", later_findings(spark, sf_dir))):
        path = scratch_dir(spark, f"signatures-{label}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        R.store_signatures(found, name, path, order=_order(), keys=KEYS, buckets=8)
        kept.append(spark.table(name))
    return X.compare_stored(*kept)


@query(
    "scan_diff_default_keys",
    f"""WITH {K.DOC_FINDINGS}, {_later_sql()},
old AS (SELECT location, pii_type, left(content, 50) AS content, arg_max([severity, CAST(confidence AS VARCHAR)], [doc_id, seq]) AS v FROM findings GROUP BY ALL),
new AS (SELECT location, pii_type, left(content, 50) AS content, arg_max([severity, CAST(confidence AS VARCHAR)], [doc_id, seq]) AS v FROM later GROUP BY ALL)
SELECT location, pii_type, content, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'resolved' WHEN o.v <> n.v THEN 'modified' ELSE 'unchanged' END AS change_type
FROM old o FULL JOIN new n USING (location, pii_type, content)""",
)
def scan_diff_default_keys(spark, sf_dir):
    return _diff(spark, sf_dir, X.DEFAULT_KEYS).select("location", "pii_type", "content", "change_type")


@query(
    "scan_diff_summary",
    f"""WITH {DIFF_SQL}, c AS (SELECT count(*) FILTER (change_type = 'new') AS new_count, count(*) FILTER (change_type = 'resolved') AS resolved_count,
  count(*) FILTER (change_type = 'modified') AS modified_count, count(*) FILTER (change_type = 'unchanged') AS unchanged_count FROM diff)
SELECT *, new_count - resolved_count AS net_change, CASE WHEN new_count > resolved_count THEN 'worse'
  WHEN new_count < resolved_count THEN 'better' ELSE 'stable' END AS trend FROM c""",
)
def scan_diff_summary(spark, sf_dir):
    return X.diff_summary(_diff(spark, sf_dir))


@query(
    "signature_sets",
    f"""WITH {DIFF_SQL} SELECT source, location, pii_type, content, CASE change_type WHEN 'new' THEN 'current only'
  WHEN 'resolved' THEN 'baseline only' ELSE 'both' END AS membership FROM diff""",
)
def signature_sets(spark, sf_dir):
    # Signatures hold detected values, so they are not written to scratch.
    old, new = X.signatures(document_findings(spark, sf_dir), KEYS), X.signatures(later_findings(spark, sf_dir), KEYS)
    return X.signature_sets(old, new, KEYS)


def _shift_sql(column: str) -> str:
    return f"""{K.DOC_FINDINGS}, {_later_sql()},
o AS (SELECT {column}, count(*) AS n FROM findings GROUP BY ALL), c AS (SELECT {column}, count(*) AS n FROM later GROUP BY ALL),
s AS (SELECT {column}, coalesce(o.n, 0) AS baseline, coalesce(c.n, 0) AS current FROM o FULL JOIN c USING ({column}))"""


@query(
    "severity_shift",
    f"""WITH {_shift_sql('severity')} SELECT severity, baseline, current, current - baseline AS change,
  CASE WHEN baseline > 0 THEN CAST(current - baseline AS DOUBLE) / baseline * 100 ELSE 0.0 END AS percent_change FROM s""",
)
def severity_shift(spark, sf_dir):
    return X.severity_shift(document_findings(spark, sf_dir), later_findings(spark, sf_dir))


@query(
    "type_shift",
    f"""WITH {_shift_sql('pii_type')} SELECT pii_type, baseline, current, current - baseline AS change,
  CASE WHEN baseline = 0 THEN 'new' WHEN current = 0 THEN 'removed' ELSE 'changed' END AS status FROM s WHERE baseline <> current""",
)
def type_shift(spark, sf_dir):
    return X.type_shift(document_findings(spark, sf_dir), later_findings(spark, sf_dir))


@query(
    "type_sets",
    f"""WITH {_shift_sql('pii_type')}
SELECT pii_type, 'any' AS membership FROM s UNION ALL SELECT pii_type, 'new' FROM s WHERE baseline = 0
UNION ALL SELECT pii_type, 'removed' FROM s WHERE current = 0 UNION ALL SELECT pii_type, 'common' FROM s WHERE baseline > 0 AND current > 0""",
)
def type_sets(spark, sf_dir):
    old = materialize(document_findings(spark, sf_dir).select("pii_type").distinct(), "types")
    new = materialize(later_findings(spark, sf_dir).select("pii_type").distinct(), "types")
    return X.type_sets(old, new)


@query(
    "diff_report",
    f"""WITH {DIFF_SQL},
c AS (SELECT count(*) FILTER (change_type = 'new') AS a, count(*) FILTER (change_type = 'resolved') AS r,
  count(*) FILTER (change_type = 'modified') AS m, count(*) FILTER (change_type = 'unchanged') AS u FROM diff)
SELECT repeat('=', 80) AS line UNION ALL SELECT 'SCAN COMPARISON REPORT' UNION ALL SELECT repeat('=', 80) UNION ALL SELECT ''
UNION ALL SELECT 'Baseline Scan: before' UNION ALL SELECT '  Timestamp: 2024-01-01T00:00:00' UNION ALL SELECT '  Total Findings: ' || count(*) FROM findings UNION ALL SELECT ''
UNION ALL SELECT 'Current Scan: after' UNION ALL SELECT '  Timestamp: None' UNION ALL SELECT '  Total Findings: ' || count(*) FROM later UNION ALL SELECT ''
UNION ALL SELECT 'SUMMARY' UNION ALL SELECT repeat('-', 80) UNION ALL SELECT '  New Findings:       ' || a FROM c
UNION ALL SELECT '  Resolved Findings:  ' || r FROM c UNION ALL SELECT '  Modified Findings:  ' || m FROM c
UNION ALL SELECT '  Unchanged Findings: ' || u FROM c UNION ALL SELECT '  Net Change:         ' || printf('%+d', a - r) FROM c
UNION ALL SELECT '  Trend:              ' || CASE WHEN a > r THEN 'WORSE' WHEN a < r THEN 'BETTER' ELSE 'STABLE' END FROM c UNION ALL SELECT ''
UNION ALL SELECT unnest(['NEW FINDINGS', repeat('-', 80), '']) FROM c WHERE a > 0
UNION ALL SELECT unnest(['RESOLVED FINDINGS', repeat('-', 80), '']) FROM c WHERE r > 0
UNION ALL SELECT unnest(['MODIFIED FINDINGS', repeat('-', 80), '']) FROM c WHERE m > 0
UNION ALL SELECT '  [' || upper(current_severity) || '] ' || pii_type || ' at ' || location || printf(' (confidence: %.2f)', current_confidence) FROM diff WHERE change_type = 'new'
UNION ALL SELECT '  [' || upper(baseline_severity) || '] ' || pii_type || ' at ' || location FROM diff WHERE change_type = 'resolved'
UNION ALL SELECT unnest(['  ' || pii_type || ' at ' || location, '    Severity: ' || baseline_severity || ' -> ' || current_severity,
  printf('    Confidence: %.2f -> %.2f', baseline_confidence, current_confidence)]) FROM diff WHERE change_type = 'modified'
UNION ALL SELECT repeat('=', 80)""",
)
def diff_report(spark, sf_dir):
    def stored(findings):
        # The report shows no values: their digests are compared, and nothing else of them is written.
        digest = F.sha2(F.left("content", F.lit(X.SIGNATURE_CONTENT)), 256)
        return materialize(findings.withColumn("content", digest).drop("context"), "findings")

    old, new = stored(document_findings(spark, sf_dir)), stored(later_findings(spark, sf_dir))
    diff = materialize(X.compare(old, new, order=_order(), keys=KEYS), "diff")

    def fact(findings, name, stamp):
        return findings.agg(F.count("*").alias("total_findings")).select(
            F.lit(name).alias("scan_id"), F.lit(stamp).cast("string").alias("timestamp"), "total_findings")

    lines = X.report_lines(diff, fact(old, "before", "2024-01-01T00:00:00"), fact(new, "after", None))
    return lines.orderBy("section", "sort_key", "part").select("line")


# --- anonymisation -------------------------------------------------------------------------


def _mask_sql(value: str = "content", kind: str = "pii_type") -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return f"""CASE {kind} WHEN 'EMAIL' THEN CASE WHEN contains({value}, '@') AND length(split_part({value}, '@', 1)) > 1
    THEN left({value}, 1) || '***@' || split_part({value}, '@', 2) ELSE '***@***.com' END
  WHEN 'PHONE_NUMBER' THEN '***-***-' || CASE WHEN length({digits}) >= 4 THEN right({digits}, 4) ELSE '****' END
  WHEN 'CREDIT_CARD' THEN '****-****-****-' || CASE WHEN length({digits}) >= 4 THEN right({digits}, 4) ELSE '****' END
  ELSE CASE WHEN length({value}) <= 4 THEN repeat('*', length({value}))
    ELSE left({value}, 1) || repeat('*', length({value}) - 2) || right({value}, 1) END END"""


def _hash_sql(value: str = "content") -> str:
    return f"'[HASH:' || left(sha256({value}), 16) || ']'"


def _chosen_sql(value: str = "content", kind: str = "pii_type") -> str:
    return f"""CASE WHEN {kind} IN ('SSN', 'CREDIT_CARD') THEN {_hash_sql(value)}
  WHEN {kind} IN ('PERSON', 'LOCATION') THEN CASE {kind} WHEN 'PERSON' THEN '[Person]' ELSE '[Location]' END
  WHEN {kind} = 'OTHER' THEN '' ELSE {_mask_sql(value, kind)} END"""


@query(
    "strategies_matrix",
    f"""WITH {K.DOC_FINDINGS}, v AS (SELECT DISTINCT pii_type, content FROM findings)
SELECT pii_type, content, CASE pii_type WHEN 'SSN' THEN 'hash' WHEN 'CREDIT_CARD' THEN 'hash' WHEN 'PERSON' THEN 'generalize'
    WHEN 'LOCATION' THEN 'generalize' WHEN 'OTHER' THEN 'suppress' ELSE 'mask' END AS preferred,
  '[REDACTED_' || pii_type || ']' AS as_redact, {_mask_sql()} AS as_mask, {_hash_sql()} AS as_hash, '[' || pii_type || ']' AS as_encrypt,
  CASE pii_type WHEN 'PERSON' THEN '[Person]' WHEN 'LOCATION' THEN '[Location]' WHEN 'DATE_OF_BIRTH' THEN '[Date]' ELSE '[' || pii_type || ']' END AS as_generalize,
  '' AS as_suppress, CASE pii_type WHEN 'EMAIL' THEN 'user@example.com' WHEN 'PHONE_NUMBER' THEN '(555) 555-5555' WHEN 'SSN' THEN '000-00-0000'
    WHEN 'CREDIT_CARD' THEN '0000-0000-0000-0000' ELSE '[SYNTHETIC_' || pii_type || ']' END AS as_synthetic FROM v""",
)
def strategies_matrix(spark, sf_dir):
    return A.strategy_matrix(document_findings(spark, sf_dir))


def _by_value_sql(chosen: str) -> str:
    """Replacements in the order of the hits, by recursion over the distinct values of a document."""
    return f"""WITH RECURSIVE {K.DOC_FINDINGS},
v AS (SELECT doc_id, pii_type, content, min(seq) AS seq FROM findings GROUP BY ALL),
n AS (SELECT doc_id, content, {chosen} AS new, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM v),
r AS (SELECT doc_id, text, 0 AS i FROM documents
  UNION ALL SELECT r.doc_id, replace(r.text, n.content, n.new), r.i + 1 FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1)
SELECT doc_id, arg_max(text, i) AS anonymized FROM r GROUP BY doc_id"""


@query("anonymize_by_value", _by_value_sql(_chosen_sql()))
def anonymize_by_value(spark, sf_dir):
    docs = D.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = D.with_detections(docs, "text", BASE)
    return found.select("doc_id", A.text_by_value(F.col("text"), F.col("detections")).alias("anonymized"))


@query("anonymize_from_findings", _by_value_sql(_chosen_sql()))
def anonymize_from_findings(spark, sf_dir):
    """The same with the findings coming from a table of their own, joined to their documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = document_findings(spark, sf_dir).withColumn("doc", F.col("source").cast("long"))
    joined = A.attach_findings(docs, found, "doc_id", "doc")
    return joined.select("doc_id", A.text_by_value(F.col("text"), F.col("detections")).alias("anonymized"))


@query(
    "anonymize_by_span",
    f"""WITH {K.DOC_FINDINGS},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM findings),
p AS (SELECT a.doc_id, a.i, substr(d.text, coalesce(b."end", 0) + 1, a.start - coalesce(b."end", 0)) ||
  {_chosen_sql('a.content', 'a.pii_type')} AS part, a."end" FROM o a JOIN documents d USING (doc_id)
  LEFT JOIN o b ON b.doc_id = a.doc_id AND b.i = a.i - 1),
j AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS head, max("end") AS last FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END AS anonymized FROM documents LEFT JOIN j USING (doc_id)""",
)
def anonymize_by_span(spark, sf_dir):
    docs = D.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = D.with_detections(docs, "text", BASE)
    return found.select("doc_id", A.text_by_span(F.col("text"), F.col("detections")).alias("anonymized"))


@query(
    "overlaps_resolved",
    f"""WITH RECURSIVE {K.spans('documents', ['doc_id'], DOCUMENT, plain=True, context=False)},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, -"end", -confidence, entity_type) AS i FROM spans),
r AS (SELECT doc_id, 0::BIGINT AS i, 0 AS pos FROM documents
  UNION ALL SELECT doc_id, i, "end" FROM (SELECT r.doc_id, o.i, o."end", row_number() OVER (PARTITION BY r.doc_id ORDER BY o.i) AS k
    FROM r JOIN o ON o.doc_id = r.doc_id AND o.i > r.i AND o.start >= r.pos) WHERE k = 1)
SELECT pii_type, count(*) AS kept FROM r JOIN o USING (doc_id, i) GROUP BY pii_type""",
)
def overlaps_resolved(spark, sf_dir):
    """Hits of all patterns that are left once overlaps are resolved, per type."""
    docs = D.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = D.with_detections(docs, "text", DOCUMENT)
    kept = found.select("doc_id", D.resolve_overlaps(F.col("detections")).alias("detections"))
    return D.explode_detections(kept, ["doc_id"]).groupBy("pii_type").agg(F.count("*").alias("kept"))


@query(
    "anonymize_columns",
    f"""WITH {CONTACTS_SQL} SELECT contact_id, {_mask_sql('full_name', "'PERSON'")} AS full_name, {_mask_sql('email_address', "'EMAIL'")} AS email_address,
  {_mask_sql('phone', "'PHONE_NUMBER'")} AS phone, {_mask_sql('ssn', "'SSN'")} AS ssn, last_login, remark, balance FROM contacts""",
)
def anonymize_columns(spark, sf_dir):
    return A.anonymize_columns(contacts(spark, sf_dir), ["full_name", "email_address", "phone", "ssn", "no_such_column"])


@query(
    "field_types",
    """SELECT p_partkey, CASE WHEN contains(f, 'email') THEN 'EMAIL' WHEN contains(f, 'phone') THEN 'PHONE_NUMBER' WHEN contains(f, 'ssn') THEN 'SSN'
  WHEN contains(f, 'card') THEN 'CREDIT_CARD' WHEN contains(f, 'name') THEN 'PERSON' WHEN contains(f, 'address') THEN 'LOCATION' ELSE 'OTHER' END AS field_type
FROM (SELECT p_partkey, lower(replace(p_name, ' ', '_') || ['_Email', '_phone', '_SSN', '_card_no', '_name', '_address', '_password', '_size'][p_size % 8 + 1]) AS f FROM part)""",
)
def field_types(spark, sf_dir):
    endings = F.array(*[F.lit(x) for x in ("_Email", "_phone", "_SSN", "_card_no", "_name", "_address", "_password", "_size")])
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(endings, F.col("p_size") % 8 + 1))
    return table(spark, sf_dir, "part").select("p_partkey", masking.type_from_field_name(name).alias("field_type"))


@query(
    "anonymized_findings",
    f"WITH {K.DOC_FINDINGS} SELECT scan_id || '_anonymized' AS scan_id, finding_id, source, pii_type, {_chosen_sql()} AS content, severity FROM findings",
)
def anonymized_findings(spark, sf_dir):
    out = A.anonymize_findings(document_findings(spark, sf_dir))
    return out.select("scan_id", "finding_id", "source", "pii_type", "content", "severity")


@query(
    "replacement_map",
    f"""WITH {K.DOC_FINDINGS}, l AS (SELECT content, arg_max(pii_type, [doc_id, seq]) AS pii_type FROM findings GROUP BY content)
SELECT content AS value, {_chosen_sql()} AS replacement FROM l""",
)
def replacement_map(spark, sf_dir):
    return A.replacement_map(document_findings(spark, sf_dir), _order())


@query(
    "encrypted_findings",
    f"WITH {K.DOC_FINDINGS} SELECT scan_id || '_anonymized' AS scan_id, finding_id, content AS decrypted, false AS shown FROM findings",
)
def encrypted_findings(spark, sf_dir):
    """Contents encrypted with a key and decrypted again; none is left readable in between."""
    key = F.lit("0123456789abcdef")
    found = document_findings(spark, sf_dir).withColumn("plain", F.col("content"))
    hidden = A.anonymize_findings(found, "encrypt", {t: "encrypt" for t in masking.STRATEGY_BY_TYPE}, key)
    back = F.aes_decrypt(F.unbase64("content"), key).cast("string")
    return hidden.select("scan_id", "finding_id", back.alias("decrypted"), F.col("content").contains(F.col("plain")).alias("shown"))


@query(
    "violation_events",
    f"""WITH {VIOLATIONS_SQL} SELECT 'compliance.violation_detected' AS event_type, scan_id, rule_id, article, severity, count(*) AS events
FROM violations GROUP BY ALL""",
)
def violation_events(spark, sf_dir):
    events = ST.violation_events(C.violations(document_findings(spark, sf_dir)))
    data = [F.col("data")[k].alias(k) for k in ("scan_id", "rule_id", "article", "severity")]
    return events.select("event_type", *data).groupBy("event_type", "scan_id", "rule_id", "article", "severity").agg(F.count("*").alias("events"))


@query(
    "saved_findings",
    f"WITH {K.DOC_FINDINGS} SELECT scan_id, pii_type, severity, count(*) AS findings FROM findings GROUP BY ALL",
)
def saved_findings(spark, sf_dir):
    """Findings saved as a scan and read again."""
    path = scratch_dir(spark, "saved")
    R.save_findings(document_findings(spark, sf_dir), path)
    return saved.read_findings(spark, path).groupBy("scan_id", "pii_type", "severity").agg(F.count("*").alias("findings"))
