"""Registered queries: detection, validators, redaction, grading, counts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from velum.functions import grading, text as textfn, validators
from velum.functions.patterns import BASE, CUSTOM, DOCUMENT, NETWORK, REDACTION_STEPS, TOPICS, VALIDATED, Pattern, for_language
from velum.functions.spans import matches_of
from velum.operators import detect as D
from velum.operators import findings as FN
from velum.operators import summary as S
from velum.plans import sqlkit as K
from velum.plans.corpus import IDENTITY_SQL, PIVOT_YEAR, document_findings, document_hits, identity_cards
from velum.plans.registry import query, table
from velum.plugins import Detector, Reader, Registry

SPAN_COLUMNS = 'pii_type, entity_type, start, "end", value, confidence'


@query(
    "pii_counts_by_type_severity",
    f"""WITH {K.DOC_FINDINGS}
SELECT pii_type, severity, count(*) AS findings, count(DISTINCT source) AS sources,
  round(avg(confidence), 4) AS avg_confidence FROM findings GROUP BY ALL""",
)
def pii_counts_by_type_severity(spark, sf_dir):
    return S.by_type_and_severity(document_findings(spark, sf_dir))


@query("pii_spans_base", f"WITH {K.spans('documents', ['doc_id'], BASE)} SELECT doc_id, seq, {SPAN_COLUMNS}, context FROM spans")
def pii_spans_base(spark, sf_dir):
    return document_hits(spark, sf_dir, keep=("doc_id",))


@query(
    "pii_spans_all",
    f"WITH {K.spans('documents', ['doc_id'], DOCUMENT, plain=True, context=False)} SELECT doc_id, seq, {SPAN_COLUMNS} FROM spans",
)
def pii_spans_all(spark, sf_dir):
    return document_hits(spark, sf_dir, DOCUMENT, keep=("doc_id",)).drop("context")


def _custom_rows() -> str:
    return ", ".join(f"({K.text(p.entity)}, {K.text(p.severity)}, {K.text(', '.join(p.articles))})" for p in CUSTOM)


@query(
    "secrets_custom_patterns",
    f"""WITH {K.spans('documents', ['doc_id'], CUSTOM, plain=True, context=False)},
attrs(entity_type, severity, gdpr_articles) AS (VALUES {_custom_rows()})
SELECT doc_id, {SPAN_COLUMNS}, severity, gdpr_articles FROM spans JOIN attrs USING (entity_type)""",
)
def secrets_custom_patterns(spark, sf_dir):
    hits = D.detect_custom(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return hits.drop("seq", "context").withColumn("gdpr_articles", F.array_join("gdpr_articles", ", "))


def _topic_sql() -> str:
    parts = []
    for t in TOPICS:
        test = " OR ".join(f"contains(low, {K.text(w)})" for w in t.keywords)
        parts.append(
            f"SELECT corpus, text_id, {K.text(t.name)} AS topic, {K.text(t.severity)} AS severity, "
            f"CAST({t.confidence} AS DOUBLE) AS confidence, {K.text(', '.join(t.articles))} AS gdpr_articles FROM t WHERE {test}"
        )
    return f"""WITH t AS (
  SELECT 'documents' AS corpus, CAST(doc_id AS VARCHAR) AS text_id, lower(text) AS low FROM documents
  UNION ALL SELECT 'conversations', conv_id || ':' || turn, lower(text) FROM conversations
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), lower(text) FROM benchmark)
{' UNION ALL '.join(parts)}"""


@query("sensitive_topics", _topic_sql())
def sensitive_topics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("text_id"), "text")
    talks = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("corpus"), F.concat_ws(":", "conv_id", "turn").alias("text_id"), "text")
    bench = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("corpus"), F.col("item_id").cast("string").alias("text_id"), "text")
    rows = D.detect_topics(docs.unionByName(talks).unionByName(bench), "text", ["corpus", "text_id"])
    return rows.withColumn("gdpr_articles", F.array_join("gdpr_articles", ", "))


@query(
    "topics_per_corpus",
    f"""SELECT corpus, topic, count(*) AS texts FROM ({_topic_sql()}) GROUP BY ALL""",
)
def topics_per_corpus(spark, sf_dir):
    return sensitive_topics(spark, sf_dir).groupBy("corpus", "topic").agg(F.count("*").alias("texts"))


def _device_text():
    key, user = F.col("event_id"), F.col("user_id")

    def hexa(c, width):
        return F.lpad(F.lower(F.hex(c)), width, "0")

    mac = F.concat_ws(":", *[hexa((key * m) % 256, 2) for m in (1, 3, 7, 11, 13, 17)])
    v6 = F.concat_ws(":", *[hexa((key * m + user) % 65536, 4) for m in (1, 31, 131, 1031, 5, 25, 125, 625)])
    lat = F.concat((key % 90).cast("string"), F.lit("."), F.lpad(user.cast("string"), 4, "0"))
    lon = F.concat(F.lit("-"), (key % 180).cast("string"), F.lit("."), F.lpad((key % 7919).cast("string"), 4, "0"))
    return F.concat(F.lit("device "), mac, F.lit(" address "), v6, F.lit(" at "), lat, F.lit(", "), lon, F.lit(" seen"))


def _hex_sql(expr: str, width: int) -> str:
    return f"lpad(lower(to_hex({expr})), {width}, '0')"


DEVICE_SQL = f"""devices AS (SELECT event_id, 'device ' || {" || ':' || ".join(_hex_sql(f"(event_id * {m}) % 256", 2) for m in (1, 3, 7, 11, 13, 17))}
  || ' address ' || {" || ':' || ".join(_hex_sql(f"(event_id * {m} + user_id) % 65536", 4) for m in (1, 31, 131, 1031, 5, 25, 125, 625))}
  || ' at ' || (event_id % 90) || '.' || lpad(CAST(user_id AS VARCHAR), 4, '0')
  || ', -' || (event_id % 180) || '.' || lpad(CAST(event_id % 7919 AS VARCHAR), 4, '0') || ' seen' AS text FROM events)"""


@query(
    "network_identifiers",
    f"WITH {DEVICE_SQL}, {K.spans('devices', ['event_id'], NETWORK, context=False)} SELECT event_id, seq, {SPAN_COLUMNS} FROM spans",
)
def network_identifiers(spark, sf_dir):
    events = D.spread(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    devices = events.select("event_id", _device_text().alias("text"))
    return D.detect(devices, "text", ["event_id"], NETWORK, spread_input=False).drop("context")


# --- validators ------------------------------------------------------------------------------

_DATE_OK = "(try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) IS NOT NULL)"


def _digits(col: str, pos: int, n: int) -> str:
    return f"CAST(substr({col}, {pos}, {n}) AS INTEGER)"


def _mod11(col: str, weights) -> str:
    total = " + ".join(f"{_digits(col, i + 1, 1)} * {w}" for i, w in enumerate(weights))
    return f"((11 - ({total}) % 11) % 11)"


def _luhn_sql(col: str) -> str:
    terms = []
    for i in range(10):
        d = _digits(col, i + 1, 1)
        terms.append(f"(CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END)" if i % 2 == 0 else d)
    return f"(({' + '.join(terms)}) % 10 = 0)"


def _danish_sql(col: str) -> str:
    yy, seventh = _digits(col, 5, 2), _digits(col, 7, 1)
    century = (
        f"(CASE WHEN {seventh} <= 3 THEN 1900 WHEN {seventh} IN (4, 9) THEN CASE WHEN {yy} <= 36 THEN 2000 ELSE 1900 END "
        f"WHEN {yy} <= 57 THEN 2000 ELSE 1800 END + {yy})"
    )
    return _DATE_OK.format(y=century, m=_digits(col, 3, 2), d=_digits(col, 1, 2))


def _swedish_sql(col: str) -> str:
    yy = _digits(col, 1, 2)
    year = f"(CASE WHEN {yy} > {PIVOT_YEAR} THEN 1900 ELSE 2000 END + {yy})"
    return f"({_DATE_OK.format(y=year, m=_digits(col, 3, 2), d=_digits(col, 5, 2))} AND {_luhn_sql(col)})"


def _norwegian_sql(col: str) -> str:
    yy, ind = _digits(col, 5, 2), _digits(col, 7, 3)
    year = (
        f"(CASE WHEN {ind} BETWEEN 500 AND 749 THEN CASE WHEN {yy} >= 54 THEN 1800 ELSE 2000 END "
        f"WHEN {ind} >= 900 AND {yy} < 40 THEN 2000 ELSE 1900 END + {yy})"
    )
    return (
        f"({_DATE_OK.format(y=year, m=_digits(col, 3, 2), d=_digits(col, 1, 2))} "
        f"AND {_mod11(col, validators.NORWEGIAN_WEIGHTS_1)} = {_digits(col, 10, 1)} "
        f"AND {_mod11(col, validators.NORWEGIAN_WEIGHTS_2)} = {_digits(col, 11, 1)})"
    )


def _finnish_sql(col: str) -> str:
    date = _DATE_OK.format(y=f"(1900 + {_digits(col, 5, 2)})", m=_digits(col, 3, 2), d=_digits(col, 1, 2))
    number = f"CAST(substr({col}, 1, 6) || substr({col}, 8, 3) AS BIGINT)"
    check = f"substr('{validators.FINNISH_CHECK_CHARS}', CAST({number} % 31 + 1 AS INTEGER), 1)"
    return f"({date} AND substr({col}, 11, 1) = {check})"


VALIDITY_SQL = f"""flat AS (SELECT *, replace(se, '-', '') AS s, replace(dk, '-', '') AS d FROM cards),
valid AS (SELECT o_orderkey, fi, se, no, dk, uk, {_finnish_sql('fi')} AS fi_ok, {_swedish_sql('s')} AS se_ok,
  {_norwegian_sql('no')} AS no_ok, {_danish_sql('d')} AS dk_ok,
  substr(uk, 1, 2) NOT IN ('GB', 'ZZ', 'DA') AND substr(uk, 9, 1) <> 'E' AS uk_ok FROM flat)"""


@query(
    "validator_results",
    f"""WITH {IDENTITY_SQL}, {VALIDITY_SQL}
SELECT o_orderkey, fi_ok, se_ok, no_ok, dk_ok, uk_ok, {_luhn_sql("replace(se, '-', '')")} AS luhn_ok FROM valid""",
)
def validator_results(spark, sf_dir):
    cards = identity_cards(spark, sf_dir)
    return cards.select(
        "o_orderkey",
        validators.finnish_id(F.col("fi")).alias("fi_ok"),
        validators.swedish_id(F.col("se"), PIVOT_YEAR).alias("se_ok"),
        validators.norwegian_id(F.col("no")).alias("no_ok"),
        validators.danish_id(F.col("dk")).alias("dk_ok"),
        validators.uk_nino(F.col("uk")).alias("uk_ok"),
        validators.luhn(F.replace(F.col("se"), F.lit("-"), F.lit(""))).alias("luhn_ok"),
    )


@query(
    "validated_ids",
    f"""WITH {IDENTITY_SQL}, {VALIDITY_SQL},
ten AS (SELECT o_orderkey, se AS value, replace(se, '-', '') AS v FROM valid
  UNION ALL SELECT o_orderkey, fi, replace(fi, '-', '') FROM valid WHERE regexp_matches(fi, '[0-9]$')),
found AS (
  SELECT o_orderkey, 'FINNISH_SSN' AS entity_type, fi AS value, 0.95 AS confidence FROM valid WHERE fi_ok
  UNION ALL SELECT o_orderkey, 'FINNISH_SSN', se, 0.85 FROM valid WHERE {_finnish_sql('se')}
  UNION ALL SELECT o_orderkey, 'SWEDISH_SSN', value, 0.80 FROM ten WHERE {_swedish_sql('v')}
  UNION ALL SELECT o_orderkey, 'DANISH_CPR', value, 0.80 FROM ten WHERE {_danish_sql('v')}
  UNION ALL SELECT o_orderkey, 'NORWEGIAN_SSN', no, 0.90 FROM valid WHERE no_ok
  UNION ALL SELECT o_orderkey, 'UK_NINO', uk, 0.95 FROM valid WHERE uk_ok)
SELECT o_orderkey, entity_type, value, CAST(confidence AS DOUBLE) AS confidence FROM found""",
)
def validated_ids(spark, sf_dir):
    """Identifiers far apart in one text: Finnish and Norwegian ones near a context word, the Swedish one not."""
    gap = F.lit(" . " * 50)
    text = F.concat(
        F.lit("hetu "), F.col("fi"), gap, F.lit("ref "), F.col("se"), gap,
        F.lit("fnr "), F.col("no"), gap, F.lit("NINO "), F.col("uk"), F.lit(" ok"),
    )
    cards = identity_cards(spark, sf_dir).select("o_orderkey", text.alias("text"))
    found = D.detect(cards, "text", ["o_orderkey"], VALIDATED, validate=True, pivot_year=PIVOT_YEAR, spread_input=False)
    return found.select("o_orderkey", "entity_type", "value", "confidence")


def _validated_sql() -> str:
    compact = "replace(replace(replace(upper(value), ' ', ''), '-', ''), '+', '')"
    checks = f"""CASE entity_type WHEN 'FINNISH_SSN' THEN {_finnish_sql("replace(upper(value), ' ', '')")}
  WHEN 'SWEDISH_SSN' THEN {_swedish_sql(f'right({compact}, 10)')} WHEN 'NORWEGIAN_SSN' THEN {_norwegian_sql(compact)}
  WHEN 'DANISH_CPR' THEN {_danish_sql(compact)}
  WHEN 'UK_NINO' THEN left({compact}, 2) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ') ELSE true END"""
    near = 'lower(substr(text, greatest(start - 100, 0) + 1, "end" + 100 - greatest(start - 100, 0)))'
    boost = " ".join(
        f"WHEN {K.text(p.entity)} THEN CASE WHEN regexp_matches({near}, {K.text('|'.join(p.keywords))}) "
        f"THEN least(0.95, round(confidence + 0.10, 2)) ELSE confidence END"
        for p in VALIDATED
    )
    return f"""WITH {K.spans('documents', ['doc_id'], VALIDATED, plain=True, context=False)},
checked AS (SELECT entity_type, doc_id, CASE entity_type {boost} END AS confidence FROM spans JOIN documents USING (doc_id) WHERE {checks})
SELECT entity_type, confidence, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM checked GROUP BY ALL"""


@query("validated_document_ids", _validated_sql())
def validated_document_ids(spark, sf_dir):
    """The validated patterns over all documents, counted by entity and confidence."""
    hits = D.detect_validated(table(spark, sf_dir, "documents"), "text", ["doc_id"], pivot_year=PIVOT_YEAR)
    return hits.groupBy("entity_type", "confidence").agg(
        F.count("*").alias("hits"), F.countDistinct("doc_id").alias("documents"))


# --- whole texts -----------------------------------------------------------------------------


def _redact_sql(column: str) -> str:
    for name, regex in REDACTION_STEPS:
        column = f"regexp_replace({column}, {K.text('(?i)' + regex)}, '[REDACTED_{name}]', 'g')"
    return column


@query("redact_text", f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents")
def redact_text(spark, sf_dir):
    docs = D.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", textfn.redact_text(F.col("text")).alias("redacted"))


@query(
    "strip_html",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')) AS stripped FROM pages""",
)
def strip_html(spark, sf_dir):
    pages = D.spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", textfn.strip_tags(F.col("html")).alias("stripped"))


# --- grading and counting --------------------------------------------------------------------


@query(
    "severity_profiles",
    f"""WITH {K.spans('documents', ['doc_id'], DOCUMENT, plain=True, context=False)}
SELECT pii_type, confidence, {K.DOCUMENT_SEVERITY} AS document_severity, {K.WEB_SEVERITY} AS web_severity,
  {K.DATABASE_SEVERITY} AS database_severity, {K.DOCUMENT_ARTICLES} AS document_articles,
  {K.WEB_ARTICLES} AS web_articles, {K.DATABASE_ARTICLES} AS database_articles, count(*) AS hits
FROM spans GROUP BY ALL""",
)
def severity_profiles(spark, sf_dir):
    counted = document_hits(spark, sf_dir, DOCUMENT).groupBy("pii_type", "confidence").agg(F.count("*").alias("hits"))
    kind, sure = F.col("pii_type"), F.col("confidence")
    profiles = ("document", "web", "database")
    return counted.select(
        "pii_type", "confidence", "hits",
        *[grading.severity(kind, sure, p).alias(f"{p}_severity") for p in profiles],
        *[F.array_join(grading.articles(kind, p), ", ").alias(f"{p}_articles") for p in profiles],
    )


@query(
    "advice_per_finding",
    f"""WITH {K.DOC_FINDINGS} SELECT finding_id, location, {K.advice()} AS recommendation, {K.advice('web')} AS web_recommendation FROM findings""",
)
def advice_per_finding(spark, sf_dir):
    found = document_findings(spark, sf_dir)
    web = grading.advice(F.col("pii_type"), F.col("severity"), "web")
    return found.select("finding_id", "location", "recommendation", web.alias("web_recommendation"))


@query(
    "entity_types",
    f"""WITH {K.spans('documents', ['doc_id'], DOCUMENT, plain=True, context=False)}
SELECT entity_type, CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'GPS_COORDINATES' THEN 'OTHER'
  WHEN 'MAC_ADDRESS' THEN 'OTHER' WHEN 'IPV6_ADDRESS' THEN 'OTHER' WHEN 'US_SSN' THEN 'SSN' ELSE entity_type END AS mapped,
  count(*) AS hits FROM spans GROUP BY ALL""",
)
def entity_types(spark, sf_dir):
    hits = document_hits(spark, sf_dir, DOCUMENT).groupBy("entity_type").agg(F.count("*").alias("hits"))
    return hits.select("entity_type", D.entity_to_type(F.col("entity_type")).alias("mapped"), "hits")


def _catalog_rows() -> str:
    return ", ".join(f"({K.text(p.entity)}, {K.text(p.description)})" for p in BASE)


@query(
    "described_hits",
    f"""WITH {K.spans('documents', ['doc_id'], BASE, context=False)},
catalog(entity_type, description) AS (VALUES {_catalog_rows()})
SELECT entity_type, description, count(*) AS hits FROM spans JOIN catalog USING (entity_type) GROUP BY ALL""",
)
def described_hits(spark, sf_dir):
    catalog = D.pattern_catalog(spark, BASE).select("entity_type", "description")
    hits = document_hits(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("hits"))
    return hits.join(F.broadcast(catalog), "entity_type")  # one row per pattern


@query(
    "confident_hits",
    f"""WITH {K.spans('documents', ['doc_id'], DOCUMENT, plain=True, context=False, threshold=0.85)}
SELECT pii_type, count(*) AS hits, min(confidence) AS lowest FROM spans GROUP BY ALL""",
)
def confident_hits(spark, sf_dir):
    hits = D.detect(table(spark, sf_dir, "documents"), "text", ["doc_id"], DOCUMENT, threshold=0.85)
    return hits.groupBy("pii_type").agg(F.count("*").alias("hits"), F.min("confidence").alias("lowest"))


def _language_sql() -> str:
    langs = ("de", "en", "es", "fi", "fr", "sv", "no", "da")
    def listed(code):
        return "[" + ", ".join(K.text(p.entity) for p in for_language(code)) + "]"
    whens = " ".join(f"WHEN {K.text(c)} THEN {listed(c)}" for c in langs)
    return f"""WITH {K.spans('documents', ['doc_id', 'lang'], DOCUMENT, plain=True, context=False)}
SELECT lang, entity_type, count(*) AS hits FROM spans
WHERE list_contains(CASE lang {whens} ELSE {listed('')} END, entity_type) GROUP BY ALL"""


@query("per_lang_detection", _language_sql())
def per_lang_detection(spark, sf_dir):
    hits = D.detect_by_language(
        table(spark, sf_dir, "documents"), "text", "lang", ["doc_id"], ("de", "en", "es", "fi", "fr", "sv", "no", "da"))
    return hits.groupBy("lang", "entity_type").agg(F.count("*").alias("hits"))


@query(
    "batch_statistics",
    f"""WITH {K.DOC_FINDINGS} SELECT scan_id, count(*) AS total_findings, count(DISTINCT source) AS files_with_findings,
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
FROM findings GROUP BY scan_id""",
)
def batch_statistics(spark, sf_dir):
    return S.batch_statistics(document_findings(spark, sf_dir))


@query("per_source_stats", f"WITH {K.DOC_FINDINGS} SELECT source, count(*) AS findings FROM findings GROUP BY source")
def per_source_stats(spark, sf_dir):
    return S.per_source(document_findings(spark, sf_dir))


@query(
    "scan_count_maps",
    f"""WITH {K.DOC_FINDINGS},
s AS (SELECT scan_id, sum(n) AS total, string_agg(severity || '=' || n, ',' ORDER BY severity) AS sev
  FROM (SELECT scan_id, severity, count(*) AS n FROM findings GROUP BY ALL) GROUP BY scan_id),
t AS (SELECT scan_id, string_agg(pii_type || '=' || n, ',' ORDER BY pii_type) AS typ
  FROM (SELECT scan_id, pii_type, count(*) AS n FROM findings GROUP BY ALL) GROUP BY scan_id)
SELECT scan_id, CAST(total AS BIGINT) AS total_findings, sev AS by_severity, typ AS by_type FROM s JOIN t USING (scan_id)""",
)
def scan_count_maps(spark, sf_dir):
    def shown(name):
        pairs = F.array_sort(F.map_entries(name))
        return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")

    maps = S.scan_maps(document_findings(spark, sf_dir))
    return maps.select("scan_id", "total_findings", shown("findings_by_severity").alias("by_severity"),
                       shown("findings_by_type").alias("by_type"))


@query(
    "type_cooccurrence",
    f"""WITH {K.spans('documents', ['doc_id'], DOCUMENT, plain=True, context=False)},
d AS (SELECT DISTINCT doc_id, pii_type FROM spans)
SELECT a.pii_type AS type_a, b.pii_type AS type_b, count(*) AS texts FROM d a JOIN d b USING (doc_id)
WHERE a.pii_type < b.pii_type GROUP BY ALL""",
)
def type_cooccurrence(spark, sf_dir):
    docs = D.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return S.cooccurrence(D.with_detections(docs, "text", DOCUMENT))


@query(
    "doc_type_summary",
    f"""WITH {K.DOC_FINDINGS}, c AS (SELECT source, pii_type, count(*) AS n FROM findings GROUP BY ALL)
SELECT source, string_agg(pii_type || ': ' || n, ', ' ORDER BY pii_type) AS summary, CAST(sum(n) AS BIGINT) AS findings
FROM c GROUP BY source""",
)
def doc_type_summary(spark, sf_dir):
    return S.type_summary(document_findings(spark, sf_dir))


@query(
    "conversation_hits",
    f"""WITH {K.spans('conversations', ['conv_id', 'turn', 'role'], DOCUMENT, plain=True, context=False)}
SELECT role, entity_type, count(*) AS hits, count(DISTINCT conv_id) AS conversations FROM spans GROUP BY ALL""",
)
def conversation_hits(spark, sf_dir):
    hits = D.detect(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn", "role"], DOCUMENT)
    return hits.groupBy("role", "entity_type").agg(
        F.count("*").alias("hits"), F.countDistinct("conv_id").alias("conversations"))


# --- plug-ins and models ---------------------------------------------------------------------

TICKET = Pattern("TOKEN_ASSIGNMENT", "OTHER", r"token = \"[0-9a-f]{8}", 0.99)
SHOUT = Pattern("SHOUTED_WORD", "OTHER", r"[A-Z]{5,}", 0.60)


@query(
    "plugin_detector",
    f"WITH {K.spans('documents', ['doc_id'], (TICKET, SHOUT), context=False)} SELECT doc_id, seq, {SPAN_COLUMNS} FROM spans",
)
def plugin_detector(spark, sf_dir):
    registry = Registry()
    registry.register(Detector("shout", lambda t: matches_of(t, SHOUT), ["OTHER"], priority=1))
    registry.register(Detector("ticket", lambda t: matches_of(t, TICKET), ["OTHER"], priority=9))
    registry.register(Detector("unused", lambda t: matches_of(t, TICKET), ["OTHER"], priority=99, enabled=False))
    docs = D.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = docs.select("doc_id", registry.detections(F.col("text")).alias("detections"))
    return D.explode_detections(found, ["doc_id"])


@query(
    "plugin_registry",
    """SELECT * FROM (VALUES ('rows', 'reader', true, 'csv'), ('shout', 'detector', false, ''), ('ticket', 'detector', true, '')) t(name, kind, enabled, endings)
JOIN (SELECT count(*) AS texts FROM documents WHERE text <> '') ON true""",
)
def plugin_registry(spark, sf_dir):
    """Plug-ins registered, replaced, switched off and unloaded; the reader that is left reads the table as sections."""
    registry = Registry()
    registry.register(Detector("ticket", lambda t: matches_of(t, SHOUT), ["OTHER"]))
    registry.register(Detector("ticket", lambda t: matches_of(t, TICKET), ["OTHER"], priority=9))
    registry.register(Detector("shout", lambda t: matches_of(t, SHOUT), ["OTHER"]))
    registry.register(Detector("gone", lambda t: matches_of(t, SHOUT), ["OTHER"]))
    registry.register(Reader("rows", lambda s, path: D.text_sections(s.read.parquet(path), "text", F.lit(path), F.col("doc_id")), "table", [".csv"]))
    registry.disable("shout")
    registry.unload("gone")
    sections = registry.reader_for(".CSV").read(spark, f"{sf_dir}/documents.parquet")
    rows = [(p["name"], p["kind"], p["enabled"], "csv" if p["kind"] == "reader" else "") for p in registry.listing()]
    listed = spark.createDataFrame(rows, "name string, kind string, enabled boolean, endings string")
    return listed.withColumn("texts", F.lit(sections.filter(F.col("text") != "").count()))


def _toy_model(texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    shape = re.compile(r"[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+")
    return [[("PERSON", m.start(), m.end(), 0.75) for m in shape.finditer(t)] for t in texts]


MODEL_SHAPE = Pattern("PERSON", "PERSON", "[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+", 0.75)


@query(
    "model_entities",
    f"""WITH {K.spans('documents', ['doc_id'], (MODEL_SHAPE,), context=False)}
SELECT doc_id, pii_type, entity_type, start, "end", value, confidence FROM spans""",
)
def model_entities(spark, sf_dir):
    """Any model can be plugged in; this one takes three capitalised words for a name."""
    return D.detect_with_model(table(spark, sf_dir, "documents"), "text", ["doc_id"], _toy_model)


# --- a text for every pattern --------------------------------------------------------------

_D6 = "lpad(CAST(c_custkey % 1000000 AS VARCHAR(6)), 6, '0')"
_D4, _D3 = (f"lpad(CAST(c_custkey % {10**n} AS VARCHAR(6)), {n}, '0')" for n in (4, 3))
_SHAPES = (
    f"'mail x' || {_D6} || '@example.com'", f"'call 555-123-' || {_D4}", f"'number 123-45-' || {_D4}", f"'card 4111 1111 1111 ' || {_D4}",
    f"'host 10.0.7.' || CAST(c_custkey % 256 AS VARCHAR(6))", f"'iban DE89370400440532' || {_D6}", f"'hetu 010190-' || {_D3} || 'A'",
    f"'pnr 900101-' || {_D4}", f"'fnr 010190 1' || {_D4}", f"'nino AB' || {_D6} || 'C'", "'swift DEUTDEFFXXX'", f"'vat DE123' || {_D6}",
    f"'wallet bc1qar1srrr7xfkvy5l643lydnw9re59g' || {_D6}", f"'passport P' || {_D6}", f"'2001:db8:85a3:1:2:8a2e:370:' || {_D4}", "'aa:bb:cc:01:02:03'",
    f"'at 52.5, 13.' || {_D3}", f"'EMP-' || {_D6}", f"'CUST-AB12' || {_D6}", f"'REF-0000' || {_D6}", f"'12-3' || {_D6}", f"'POL-12' || {_D6}",
    f"'VIN 1HGCM82633A' || {_D6}", f"'account 12' || {_D6}", f"'HI-123' || {_D6}", f"'MEM-' || {_D6}", f"'api_key = abcdefghijklmnopqrst' || {_D6}",
    f"'AKIAIOSFODNN77' || {_D6}", "'-----BEGIN RSA PRIVATE KEY-----'",
)
# The same expression in both dialects; every other customer also has things that are almost hits.
_SHAPED = (
    f"CASE c_custkey % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES))
    + " END || CASE WHEN c_custkey % 2 = 0 THEN ', EMP-123 REF-12 4111-1111 1.2.3 12-34 x@y AKIA12 a:b:c' ELSE '' END"
)


@query(
    "every_pattern",
    f"""WITH samples AS (SELECT c_custkey, {_SHAPED} AS text FROM customer),
{K.spans('samples', ['c_custkey'], (*DOCUMENT, *CUSTOM), context=False)} SELECT c_custkey, seq, {SPAN_COLUMNS} FROM spans""",
)
def every_pattern(spark, sf_dir):
    """Texts made from ``customer`` with the shape of every document and custom pattern, and near misses."""
    samples = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SHAPED).alias("text"))
    return D.detect(samples, "text", ["c_custkey"], (*DOCUMENT, *CUSTOM)).drop("context")
