"""SQL fragments shared by the check queries."""

from __future__ import annotations

from collections.abc import Sequence

from velum.functions.patterns import BASE, Pattern

# RE2 knows only ASCII word boundaries. With every other letter and digit turned into
# an underscore (a word character that no pattern matches) they fall in the same places.
PLAIN = r"regexp_replace({t}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]', '_', 'g')"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ascii_letters(column: str) -> str:
    return PLAIN.format(t=column)


def spans(
    source: str, keys: Sequence[str], patterns: Sequence[Pattern], column: str = "text", plain: bool = False,
    threshold: float = 0.5, context: bool = True,
) -> str:
    """CTE list ``spans(keys…, seq, pii_type, entity_type, start, "end", value, confidence, context)``."""
    key = ", ".join(keys)
    parts = []
    for i, p in enumerate(patterns):
        searched = "__plain" if plain and p.pii_type != "EMAIL" else column
        rx = text(p.java_regex)
        parts.append(
            f"SELECT {key}, {column} AS __text, {i} AS __rank, {text(p.pii_type)} AS pii_type, "
            f"{text(p.entity)} AS entity_type, CAST({p.confidence} AS DOUBLE) AS confidence, "
            f"regexp_extract_all({searched}, {rx}) AS __hits, regexp_split_to_array({searched}, {rx}) AS __gaps "
            f"FROM __in WHERE regexp_matches({searched}, {rx})"
        )
    plain_col = f", {ascii_letters(column)} AS __plain" if plain else ""
    ctx = (
        """, replace(substr(__text, greatest(start - 50, 0) + 1, "end" + 50 - greatest(start - 50, 0)), chr(10), ' ') AS context"""
        if context
        else ""
    )
    return f"""__in AS (SELECT *{plain_col} FROM {source}),
__hit AS ({' UNION ALL '.join(parts)}),
__one AS (SELECT *, unnest(__hits) AS value, generate_subscripts(__hits, 1) AS __i FROM __hit),
__pos AS (SELECT *, CAST(list_sum(list_transform(__gaps[1:__i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(__hits[1:__i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM __one),
__end AS (SELECT *, CAST(start + length(value) AS INTEGER) AS "end" FROM __pos WHERE confidence >= {threshold}),
spans AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY __rank, start) - 1 AS INTEGER) AS seq,
  pii_type, entity_type, start, "end", value, confidence{ctx} FROM __end)"""


def case_of(column: str, table: dict[str, Sequence[str]], default: str) -> str:
    whens = " ".join(
        f"WHEN {column} IN ({', '.join(text(t) for t in types)}) THEN {text(level)}" for level, types in table.items()
    )
    return f"CASE {whens} ELSE {text(default)} END"


DOCUMENT_SEVERITY = """CASE
  WHEN pii_type IN ('SSN', 'CREDIT_CARD', 'PASSPORT') THEN CASE WHEN confidence < 0.7 THEN 'high' ELSE 'critical' END
  WHEN pii_type IN ('MEDICAL_LICENSE', 'DRIVER_LICENSE', 'EMAIL', 'PHONE_NUMBER', 'IBAN')
    THEN CASE WHEN confidence < 0.6 THEN 'medium' ELSE 'high' END
  WHEN pii_type IN ('DATE_OF_BIRTH', 'LOCATION', 'PERSON', 'IP_ADDRESS') THEN 'medium'
  WHEN pii_type IN ('ORGANIZATION', 'URL', 'OTHER') THEN 'low'
  ELSE 'medium' END"""

WEB_SEVERITY = """CASE
  WHEN pii_type IN ('SSN', 'CREDIT_CARD', 'PASSPORT') THEN 'critical'
  WHEN pii_type IN ('EMAIL', 'PHONE_NUMBER', 'IBAN') THEN 'high' ELSE 'medium' END"""

DATABASE_SEVERITY = """CASE
  WHEN pii_type IN ('SSN', 'CREDIT_CARD', 'PASSPORT', 'MEDICAL_LICENSE', 'CRYPTO_ADDRESS') THEN 'critical'
  WHEN pii_type IN ('DATE_OF_BIRTH', 'DRIVER_LICENSE') THEN 'high' ELSE 'medium' END"""

DOCUMENT_ARTICLES = """CASE
  WHEN pii_type IN ('SSN', 'MEDICAL_LICENSE', 'DATE_OF_BIRTH') THEN 'Art. 5, Art. 9, Art. 32'
  WHEN pii_type IN ('CREDIT_CARD', 'IBAN') THEN 'Art. 5, Art. 6, Art. 32' ELSE 'Art. 5, Art. 6' END"""

WEB_ARTICLES = """CASE
  WHEN pii_type IN ('SSN', 'MEDICAL_LICENSE') THEN 'Art. 5, Art. 9, Art. 32'
  WHEN pii_type IN ('CREDIT_CARD', 'IBAN') THEN 'Art. 5, Art. 6, Art. 32' ELSE 'Art. 5, Art. 6' END"""

DATABASE_ARTICLES = """CASE
  WHEN pii_type IN ('SSN', 'MEDICAL_LICENSE', 'PASSPORT') THEN 'Art. 9, Art. 32' ELSE 'Art. 6, Art. 32' END"""

FINDING_ID = "sha256(concat_ws('|', {source}, {location}, pii_type, CAST(start AS VARCHAR)))"

# Findings of the base patterns in ``documents``: one scan per ``documents.source``.
DOC_FINDINGS = (
    spans("documents", ["doc_id", "source"], BASE)
    + f""",
findings AS (SELECT source AS scan_id, doc_id, CAST(doc_id AS VARCHAR) AS source, 'Document' AS location, seq,
  pii_type, value AS content, context, start, "end", confidence, {DOCUMENT_SEVERITY} AS severity,
  {DOCUMENT_ARTICLES} AS gdpr_articles,
  {FINDING_ID.format(source="CAST(doc_id AS VARCHAR)", location="'Document'")} AS finding_id
  FROM spans)"""
)


def advice(profile: str = "document") -> str:
    from velum.functions.grading import ADVICE, DEFAULT_ADVICE

    whens = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in ADVICE.get(profile, {}).items())
    base = f"CASE pii_type {whens} ELSE {text(DEFAULT_ADVICE[profile])} END"
    if profile != "document":
        return base
    return (
        f"CASE severity WHEN 'critical' THEN 'CRITICAL: ' || {base} || ' Immediate action required.' "
        f"WHEN 'high' THEN 'HIGH PRIORITY: ' || {base} ELSE {base} END"
    )
