"""Inputs of the registered queries: findings of the given texts, and records derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.patterns import BASE, with_confidence
from velum.functions.text import fixed
from velum.operators.detect import detect
from velum.operators.findings import to_findings
from velum.plans.registry import table
from velum.session import spread

PIVOT_YEAR = 25
# What the later scan finds besides.
LATER_TEXT = "\nSSN 123-45-6789"


def document_hits(spark: SparkSession, sf_dir: str, patterns=BASE, keep=("doc_id", "source")) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), "text", list(keep), patterns)


def document_findings(spark: SparkSession, sf_dir: str, patterns=BASE) -> DataFrame:
    """Base findings of all documents: one scan per ``source``, one source per document."""
    hits = document_hits(spark, sf_dir, patterns)
    return to_findings(hits, scan_id=F.col("source"), source=F.col("doc_id"))


def later_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents scanned again after an edit and with a surer address detector.

    The edit changes every text: each ``0`` becomes ``8`` and each ``@`` becomes ``#``, and the texts of
    ``src1`` get a social security number. So values with a zero turn into others, addresses vanish, a type
    appears, card numbers without a zero stay, and all IP findings change their confidence.
    """
    added = F.when(F.col("source") == "src1", F.lit(LATER_TEXT)).otherwise("")
    edited = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.translate("text", "0@", "8#"), added).alias("text"))
    hits = detect(edited, "text", ["doc_id", "source"], with_confidence(BASE, {"IP_ADDRESS": 0.95}))
    return to_findings(hits, scan_id=F.col("source"), source=F.col("doc_id"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per ``documents.source``, also those without findings."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("scan_id")).agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.sum("n_chars").alias("chars")
    )
    return docs.select(
        "scan_id",
        F.concat(F.lit("corpus/"), F.col("scan_id")).alias("source"),
        F.lit("document").alias("source_type"),
        F.lit("completed").alias("status"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, first_doc)").alias("start_time"),
        (F.col("chars") / 1000).alias("duration_seconds"),
        "documents",
    )


SCANS_SQL = """scans AS (SELECT source AS scan_id, 'corpus/' || source AS source, 'document' AS source_type,
  'completed' AS status, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(min(doc_id)) AS start_time,
  sum(n_chars) / 1000.0 AS duration_seconds, count(*) AS documents FROM documents GROUP BY source)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with personal columns, made from ``customer``: one contact per customer."""
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 6, "0")
    ssn = F.concat(F.lpad((key % 900 + 100).cast("string"), 3, "0"), F.lit("-"),
                   F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 9000 + 1000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "customer").select(
        key.alias("contact_id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower("c_mktsegment"), F.lit("."), digits, F.lit("@example.com")).alias("email_address"),
        F.concat(F.lit("555-"), F.lpad((key % 900 + 100).cast("string"), 3, "0"), F.lit("-"),
                 F.lpad((key % 10000).cast("string"), 4, "0")).alias("phone"),
        F.when(F.col("c_nationkey") < 20, ssn).alias("ssn"),
        F.concat(F.lit("10."), (key % 250).cast("string"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit(".7"))
        .alias("last_login"),
        F.concat(F.lit("note "), F.col("c_mktsegment"), F.when(key % 25 == 0, F.concat(F.lit(" mail x"), digits, F.lit("@example.org")))
                 .otherwise("")).alias("remark"),
        F.col("c_acctbal").alias("balance"),
    )


CONTACTS_SQL = """contacts AS (SELECT c_custkey AS contact_id, c_name AS full_name,
  lower(c_mktsegment) || '.' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '@example.com' AS email_address,
  '555-' || lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
  CASE WHEN c_nationkey < 20 THEN lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') || '-'
    || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 9000 + 1000 AS VARCHAR), 4, '0') END AS ssn,
  '10.' || (c_custkey % 250) || '.' || c_nationkey || '.7' AS last_login,
  'note ' || c_mktsegment || CASE WHEN c_custkey % 25 = 0 THEN ' mail x' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '@example.org' ELSE '' END AS remark,
  c_acctbal AS balance FROM customer)"""


def identity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National identifiers made from ``orders``: some with right check digits, some without."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    ddmmyy, yymmdd = F.date_format(day, "ddMMyy"), F.date_format(day, "yyMMdd")
    serial = F.lpad((key % 1000).cast("string"), 3, "0")
    index = (F.concat(ddmmyy, serial).cast("long") % 31 + 1).cast("int")
    check = F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), index, F.lit(1))
    letters = F.array(*[F.lit(x) for x in ("AB", "GB", "CE", "ZZ", "JK", "DA", "PR")])
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(
        "o_orderkey",
        F.concat(ddmmyy, F.lit("-"), serial, F.when(key % 2 == 0, check).otherwise("T")).alias("fi"),
        F.concat(yymmdd, F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("se"),
        F.concat(ddmmyy, F.lpad(((key * 7919) % 100000).cast("string"), 5, "0")).alias("no"),
        F.concat(F.lpad((key % 40).cast("string"), 2, "0"), F.date_format(day, "MMyy"), F.lit("-"),
                 F.lpad((key % 10000).cast("string"), 4, "0")).alias("dk"),
        F.concat(F.element_at(letters, (key % 7 + 1).cast("int")), F.lpad((key % 1000000).cast("string"), 6, "0"),
                 F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (key % 5 + 1).cast("int"))).alias("uk"),
    )


IDENTITY_SQL = """cards AS (SELECT o_orderkey, dm || '-' || serial || CASE WHEN o_orderkey % 2 = 0
    THEN substr('0123456789ABCDEFHJKLMNPRSTUVWXY', CAST(CAST(dm || serial AS BIGINT) % 31 + 1 AS INTEGER), 1) ELSE 'T' END AS fi,
  strftime(o_orderdate, '%y%m%d') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS se,
  dm || lpad(CAST((o_orderkey * 7919) % 100000 AS VARCHAR), 5, '0') AS no,
  lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') || strftime(o_orderdate, '%m%y') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS dk,
  ['AB', 'GB', 'CE', 'ZZ', 'JK', 'DA', 'PR'][o_orderkey % 7 + 1] || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')
    || ['A', 'B', 'C', 'D', 'E'][o_orderkey % 5 + 1] AS uk
  FROM (SELECT *, strftime(o_orderdate, '%d%m%y') AS dm, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS serial FROM orders))"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of an audit trail."""
    names = {"view": "access_granted", "click": "pii_detected", "error": "access_denied",
             "signup": "scan_started", "purchase": "scan_completed"}
    event = None
    for given, name in names.items():
        test = F.col("event_type") == given
        event = F.when(test, name) if event is None else event.when(test, name)
    result = F.when(F.col("event_type") == "error", "denied").when(F.col("value") < 5, "failure").otherwise("success")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"),
        event.alias("event"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("item-"), F.get_json_object("props", "$.k")).alias("resource"),
        F.col("event_type").alias("action"),
        result.alias("result"),
        F.create_map(F.lit("value"), fixed(F.col("value"))).alias("details"),
        F.col("event_id").alias("log_seq"),
    )


AUDIT_SQL = """audit AS (SELECT ts AS "timestamp", CASE event_type WHEN 'view' THEN 'access_granted' WHEN 'click' THEN 'pii_detected'
    WHEN 'error' THEN 'access_denied' WHEN 'signup' THEN 'scan_started' WHEN 'purchase' THEN 'scan_completed' END AS event,
  'user' || user_id AS "user", 'item-' || json_extract_string(props, '$.k') AS resource, event_type AS action,
  CASE WHEN event_type = 'error' THEN 'denied' WHEN value < 5 THEN 'failure' ELSE 'success' END AS result,
  event_id AS log_seq FROM events)"""


def web_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a form and cookies each, made from ``supplier`` and ``customer`` keys."""
    key = F.col("c_custkey")
    url = F.concat(F.when(key % 3 == 0, "http").otherwise("https"), F.lit("://shop"), F.col("c_nationkey").cast("string"),
                   F.lit(".example.com/p/"), key.cast("string"))
    action = F.when(key % 4 == 0, "").when(key % 4 == 1, "/submit").when(key % 4 == 2, "https://pay.example.com/go").otherwise(
        "http://old.example.com/go")
    second = F.when(key % 5 == 0, '<input type="text" name="quantity">').when(
        key % 5 == 1, "<input name='user_name' placeholder='Your name'>").otherwise(
        '<textarea name="remarks" placeholder="Home address"></textarea>')
    first = F.when(key % 2 == 0, '<input type="email" name="Email">').otherwise('<select name="colour"></select>')
    method = F.when(key % 2 == 0, ' method="post"').otherwise("")
    html = F.concat(
        F.lit("<html><head><title>Shop "), key.cast("string"), F.lit("</title><script>var f='<form>';</script></head><body><p>Order</p>"),
        F.lit('<form action="'), action, F.lit('"'), method, F.lit(">"), first, second, F.lit("</form>"),
        F.when(key % 6 == 0, '<a href="/legal/privacy">Legal</a>').otherwise('<a href="/about">About us</a>'),
        F.lit("</body></html>"),
    )
    names = F.array(F.lit("_ga"), F.lit("ad_tracker"), F.lit("sessionid"), F.lit("theme"))
    cookie = F.struct(
        F.element_at(names, (key % 4 + 1).cast("int")).alias("name"), (key % 3 != 0).alias("secure"),
        F.lit(True).alias("httponly"), F.lit("Lax").alias("samesite"),
    )
    headers = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"),
        F.when(key % 7 == 0, "Strict-Transport-Security").otherwise("X-Powered-By"), F.lit("x"),
        F.when(key % 11 == 0, "Content-Security-Policy").otherwise("X-Frame-Options"), F.lit("y"),
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(
        key.alias("page_id"), url.alias("url"), html.alias("html"), F.array(cookie).alias("cookies"), headers.alias("headers")
    )


FORMS_SQL = """pages_made AS (SELECT c_custkey AS page_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'http' ELSE 'https' END || '://shop' || c_nationkey || '.example.com/p/' || c_custkey AS url,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/submit' WHEN 2 THEN 'https://pay.example.com/go' ELSE 'http://old.example.com/go' END AS action,
  CASE WHEN c_custkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN c_custkey % 2 = 0 THEN 'Email' ELSE 'colour' END AS first_name,
  CASE c_custkey % 5 WHEN 0 THEN 'quantity' WHEN 1 THEN 'user_name' ELSE 'remarks' END AS second_name,
  CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS pii_fields,
  CASE c_custkey % 4 WHEN 0 THEN '_ga' WHEN 1 THEN 'ad_tracker' WHEN 2 THEN 'sessionid' ELSE 'theme' END AS cookie,
  CASE c_custkey % 4 WHEN 0 THEN 'analytics' WHEN 1 THEN 'advertising' WHEN 2 THEN 'functional' ELSE 'unknown' END AS cookie_type,
  c_custkey % 3 <> 0 AS secure, c_custkey % 7 = 0 AS hsts, c_custkey % 11 = 0 AS csp, c_custkey % 6 = 0 AS policy
  FROM customer)"""
