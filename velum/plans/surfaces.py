"""Registered queries: tables and stored web pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.flows import scan_folder, scan_pages
from velum.functions import text as textfn
from velum.functions.patterns import DOCUMENT
from velum.operators import pages as P
from velum.operators import tables as T
from velum.operators.compliance import compliance
from velum.plans import sqlkit as K
from velum.plans.corpus import CONTACTS_SQL, FORMS_SQL, contacts, web_forms
from velum.plans.registry import query, table
from velum.session import scratch_dir, spread
from velum.sources import tree as TREE
from velum.sources.files import base_name, unsupported

# --- tables --------------------------------------------------------------------------------

_ENDINGS = ("_email", "_phone", "_ssn", "_password", "_dob", "_license_no", "_health", "_size", "_address", "_colour")


def _hint_sql(name: str, what: int) -> str:
    whens = " ".join(f"WHEN contains(lower({name}), {K.text(h[0])}) THEN {K.text(h[what])}" for h in T.COLUMN_HINTS)
    return f"CASE {whens} END"


@query(
    "column_name_scan",
    f"""WITH c AS (SELECT p_brand AS table_name, replace(p_name, ' ', '_') || [{', '.join(K.text(e) for e in _ENDINGS)}][p_size % 10 + 1] AS column_name,
  lower(p_type) AS data_type FROM part),
n AS (SELECT *, {_hint_sql('column_name', 1)} AS pii_type, {_hint_sql('column_name', 2)} AS severity FROM c)
SELECT 'parts_db' AS source, table_name || '.' || column_name AS location, pii_type, severity, CAST(0.75 AS DOUBLE) AS confidence,
  'Column: ' || column_name || ' (type: ' || data_type || ')' AS content, {K.DATABASE_ARTICLES} AS gdpr_articles FROM n WHERE pii_type IS NOT NULL""",
)
def column_name_scan(spark, sf_dir):
    """Column names made from ``part``: a catalogue that grows with the data."""
    endings = F.array(*[F.lit(e) for e in _ENDINGS])
    columns = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_name"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(endings, F.col("p_size") % 10 + 1)).alias("column_name"),
        F.lower("p_type").alias("data_type"),
    )
    found = T.scan_column_names(columns, F.lit("parts_db"))
    return found.select("source", "location", "pii_type", "severity", "confidence", "content",
                        F.array_join("gdpr_articles", ", ").alias("gdpr_articles"))


def _profile_sql(name: str, source: str, columns) -> str:
    long = " UNION ALL ".join(
        f"SELECT {K.text(c)} AS column_name, CAST({e} AS VARCHAR) AS v FROM {source} WHERE {c} IS NOT NULL" for c, e in columns)
    kinds = list(dict.fromkeys(p.pii_type for p in DOCUMENT))
    counts = " UNION ALL ".join(
        f"""SELECT column_name, {K.text(k)} AS pii_type, CAST(sum({' + '.join(
            f"len(regexp_extract_all(v, {K.text(p.java_regex)}))" for p in DOCUMENT if p.pii_type == k)}) AS BIGINT) AS hits,
  count(*) AS "values" FROM l GROUP BY column_name""" for k in kinds)
    return f"""(WITH l AS ({long}), h AS ({counts})
SELECT {K.text(name)} AS table_name, column_name, pii_type, hits, "values", CAST(hits AS DOUBLE) / "values" * 100 AS percent FROM h WHERE hits > 0)"""


def _all_columns(*names: str) -> list[tuple[str, str]]:
    """Column and SQL expression; amounts are shown with two decimals on both sides."""
    money = ("balance", "o_totalprice", "s_acctbal", "c_acctbal")
    return [(c, f"CAST({c} AS DECIMAL(18, 2))" if c in money else c) for c in names]


def _amounts(df: DataFrame) -> DataFrame:
    """Doubles as decimals with two places, in all columns of a table."""
    return df.select(*[F.col(f.name).cast("decimal(18,2)").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


_CONTACT_COLUMNS = _all_columns("contact_id", "full_name", "email_address", "phone", "ssn", "last_login", "remark", "balance")


@query("column_profile", f"WITH {CONTACTS_SQL} SELECT * FROM {_profile_sql('contacts', 'contacts', _CONTACT_COLUMNS)}")
def column_profile(spark, sf_dir):
    return T.profile_columns(_amounts(contacts(spark, sf_dir)), "contacts")


_DB_TABLES = {
    "contacts": _CONTACT_COLUMNS,
    "orders": _all_columns("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "supplier": _all_columns("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}


def _database_sql() -> str:
    profiles = " UNION ALL ".join(f"SELECT * FROM {_profile_sql(n, n, cols)}" for n, cols in _DB_TABLES.items())
    hinted = ", ".join(f"({K.text(n)}, {K.text(c)})" for n, cols in _DB_TABLES.items() for c, _ in cols)
    return f"""WITH {CONTACTS_SQL}, p AS ({profiles}),
n(table_name, column_name) AS (VALUES {hinted}),
named AS (SELECT table_name || '.' || column_name AS location, {_hint_sql('column_name', 1)} AS pii_type,
  {_hint_sql('column_name', 2)} AS severity, CAST(0.75 AS DOUBLE) AS confidence FROM n)
SELECT * FROM named WHERE pii_type IS NOT NULL
UNION ALL SELECT table_name || '.' || column_name, pii_type, {K.DATABASE_SEVERITY}, CAST(0.85 AS DOUBLE) FROM p WHERE percent >= 5
UNION ALL SELECT 'database_schema', 'OTHER', 'medium', CAST(0.6 AS DOUBLE)
UNION ALL SELECT 'database_schema', 'OTHER', 'medium', CAST(0.7 AS DOUBLE)"""


@query("database_scan", _database_sql())
def database_scan(spark, sf_dir):
    """Names, whole contents and schema of three tables as one plan."""
    tables = {name: _amounts(contacts(spark, sf_dir) if name == "contacts" else table(spark, sf_dir, name)) for name in _DB_TABLES}
    return T.scan_database(tables, "sqlite:///shop.db", {}, rows=None).select("location", "pii_type", "severity", "confidence")


@query(
    "table_samples",
    """SELECT 'top' AS side, o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)
UNION ALL SELECT 'bottom', o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1000)""",
)
def table_samples(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    top, bottom = T.sample(orders, "o_orderkey", strategy="top"), T.sample(orders, "o_orderkey", strategy="bottom")
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


@query(
    "table_sample_random",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000""",
)
def table_sample_random(spark, sf_dir):
    return T.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(
    "audit_table_check",
    """WITH t AS (SELECT p_brand AS source, replace(p_name, ' ', '_') || CASE WHEN p_retailprice > 1000 AND p_size = 7 THEN '_Audit'
  WHEN p_partkey % 977 = 0 THEN '_history' ELSE '_data' END AS table_name FROM part)
SELECT source, 'database_schema' AS location, 'No audit tables detected' AS content, 'medium' AS severity, CAST(0.7 AS DOUBLE) AS confidence
FROM t GROUP BY source HAVING NOT bool_or(regexp_matches(lower(table_name), 'audit|log|history|changelog'))
UNION ALL SELECT DISTINCT source, 'database_schema', 'Database encryption configuration', 'medium', CAST(0.6 AS DOUBLE) FROM t""",
)
def audit_table_check(spark, sf_dir):
    """Each brand stands for a database whose table names come from its parts."""
    ending = F.when((F.col("p_retailprice") > 1000) & (F.col("p_size") == 7), "_Audit").when(
        F.col("p_partkey") % 977 == 0, "_history").otherwise("_data")
    names = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), ending).alias("table_name"))
    missing = T.audit_findings(T.check_audit_tables(names, keys=["source"]), F.col("source"))
    reminder = T.check_encryption(names.select("source").distinct(), F.col("source"))
    return missing.unionByName(reminder).select("source", "location", "content", "severity", "confidence")


_SCHEMES = ("postgresql://u@h/db", "mysql+pymysql://u@h/db", "sqlite:///", "mssql+pyodbc://h/db", "oracle://h/db", "invalid://x", "no-scheme ")


@query(
    "connection_strings",
    f"""WITH c AS (SELECT s_suppkey, [{', '.join(K.text(s) for s in _SCHEMES)}][s_suppkey % 7 + 1] || s_suppkey AS source FROM supplier)
SELECT s_suppkey, source, split_part(split_part(source, ':', 1), '+', 1) IN ('postgresql', 'mysql', 'sqlite', 'mssql') AS valid FROM c""",
)
def connection_strings(spark, sf_dir):
    kinds = F.array(*[F.lit(s) for s in _SCHEMES])
    source = F.concat(F.element_at(kinds, (F.col("s_suppkey") % 7 + 1).cast("int")), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", source.alias("source"))
    return rows.withColumn("valid", textfn.is_database_url(F.col("source")))


_FILE_NAMES = (".pdf", ".DOCX", ".txt", ".PNG", ".xlsx", ".eml", ".msg", ".py", ".json", ".Text")
_FILE_LABELS = ("pdf", "docx", "text", "image", "excel", "eml", "msg", None, None, "text")


@query(
    "file_kinds",
    f"""SELECT '/data/' || p_partkey || '/' || replace(p_name, ' ', '.') || [{', '.join(K.text(e) for e in _FILE_NAMES)}][p_size % 10 + 1] AS path,
  [{', '.join('NULL' if e is None else K.text(e) for e in _FILE_LABELS)}][p_size % 10 + 1] AS kind,
  CASE WHEN p_size % 10 IN (7, 8) THEN 'Unsupported file type: ' || lower([{', '.join(K.text(e) for e in _FILE_NAMES)}][p_size % 10 + 1]) END AS error FROM part""",
)
def file_kinds(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in _FILE_NAMES])
    path = F.concat(F.lit("/data/"), F.col("p_partkey").cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")),
                    F.element_at(endings, F.col("p_size") % 10 + 1))
    paths = table(spark, sf_dir, "part").select(path.alias("path"))
    good = paths.withColumn("kind", textfn.file_kind(F.col("path"))).filter(F.col("kind").isNotNull())
    bad = unsupported(paths).withColumn("kind", F.lit(None).cast("string"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@query(
    "rows_as_text",
    """SELECT c_custkey, c_custkey || chr(9) || c_name || chr(9) || c_nationkey || chr(9) || CAST(c_acctbal AS DECIMAL(18, 2)) || chr(9) || c_mktsegment AS line
FROM customer""",
)
def rows_as_text(spark, sf_dir):
    customers = _amounts(table(spark, sf_dir, "customer"))
    return T.rows_as_text(customers, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], row_number="c_custkey")


@query(
    "rows_as_structured_text",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS row_number FROM supplier)
SELECT row_number, 'Row ' || (row_number + 1) || ': s_suppkey: ' || s_suppkey || ' | s_name: ' || s_name || ' | s_nationkey: ' || s_nationkey || ' | s_acctbal: ' || CAST(s_acctbal AS DECIMAL(18, 2)) AS line FROM n""",
)
def rows_as_structured_text(spark, sf_dir):
    numbered = T.number_rows(_amounts(table(spark, sf_dir, "supplier")), "s_suppkey")
    return T.rows_as_text(numbered, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], structured=True, row_number="row_number")


@query(
    "sheet_texts",
    """WITH r AS (SELECT n_regionkey AS sheet, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, n_nationkey, n_name FROM nation)
SELECT sheet, 'Headers: n_nationkey, n_name' || chr(10) || string_agg('Row ' || (n + 1) || ': n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name, chr(10) ORDER BY n) AS text,
  string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n) AS plain FROM r GROUP BY sheet""",
)
def sheet_texts(spark, sf_dir):
    """The nations of a region as a sheet: its text with headers, and plain."""
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = table(spark, sf_dir, "nation").withColumn("n", n)
    columns = ["n_nationkey", "n_name"]

    def texts(structured):
        parts = [T.rows_as_text(rows.filter(F.col("n_regionkey") == k), columns, structured=structured, row_number="n").withColumn("sheet", F.lit(k)) for k in range(5)]
        return T.sheet_text(reduce(DataFrame.unionByName, parts), columns, "n", ["sheet"], structured=structured)

    return texts(True).join(texts(False).withColumnRenamed("text", "plain"), "sheet")


@query("numbered_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders")
def numbered_rows(spark, sf_dir):
    return T.number_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


# --- folders ---------------------------------------------------------------------------------

_FILE_SQL = """f AS (SELECT 'n' || contact_id % 5 || CASE contact_id % 3 WHEN 0 THEN '/_drafts/c' WHEN 1 THEN '/.c' ELSE '/c' END || contact_id
    || CASE WHEN contact_id % 7 = 0 THEN '.pdf' WHEN contact_id % 2 = 0 THEN '.TXT' ELSE '.text' END AS path,
  concat_ws(chr(10), full_name, email_address, phone, ssn, remark) AS text FROM contacts)"""


def _written_contacts(spark, sf_dir) -> str:
    """One file a contact below a scratch folder: some hidden, in hidden folders, or of a kind without a reader."""
    key = F.col("contact_id")
    name = F.concat(
        F.lit("n"), key % 5, F.when(key % 3 == 0, "/_drafts/c").when(key % 3 == 1, "/.c").otherwise("/c"), key,
        F.when(key % 7 == 0, ".pdf").when(key % 2 == 0, ".TXT").otherwise(".text"))
    body = F.concat_ws("\n", "full_name", "email_address", "phone", "ssn", "remark")
    path = scratch_dir(spark, "folder")

    def write(frames):
        system, top, _ = TREE.opened(path)
        made = set()
        for frame in frames:
            for name_, text in zip(frame["name"], frame["text"]):
                folder = f"{top}/{name_}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{name_}") as f:
                    f.write(text.encode())
            yield frame[["name"]]

    # A table of many contacts is still few bytes, so it comes in one split or a few; every row costs a file.
    # Each task fills one folder after another, in an order of its own: tasks that add files to one folder wait for each other.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = contacts(spark, sf_dir).select(name.alias("name"), body.alias("text")).repartition(tasks, "name")
    turn = F.xxhash64(F.regexp_replace("name", "/[^/]*$", ""), F.spark_partition_id())
    rows = rows.withColumn("turn", turn).sortWithinPartitions("turn")
    rows.mapInPandas(write, "name string").count()
    return path


@query(
    "folder_scan",
    f"""WITH {CONTACTS_SQL}, {_FILE_SQL}, r AS (SELECT * FROM f WHERE path NOT LIKE '%.pdf'),
{K.spans('r', ['path'], DOCUMENT, plain=True, context=False)}
SELECT regexp_extract(path, '[^/]*$') AS file, pii_type, value AS content FROM spans
UNION ALL SELECT regexp_extract(path, '[^/]*$'), 'error', 'No reader for .pdf' FROM f WHERE path LIKE '%.pdf'""",
)
def folder_scan(spark, sf_dir):
    folder = _written_contacts(spark, sf_dir)
    scan = scan_folder(spark, folder, scan_id="folder")
    found = scan.findings.select(F.col("source").alias("file"), "pii_type", "content")
    return found.unionByName(scan.errors.select(base_name(F.col("path")).alias("file"), F.lit("error").alias("pii_type"), F.col("error").alias("content")))


# --- pages ---------------------------------------------------------------------------------


def _decoded(expr: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


_VISIBLE = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), "
    "'(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?s)<!--.*?-->|<![^>]*>', '', 'g')"
)
_TEXT = (
    f"array_to_string(list_filter(list_transform(regexp_split_to_array({_decoded(f'''regexp_replace({_VISIBLE}, '<[^>]+>', chr(10), 'g')''')}, "
    "'\\r\\n|[\\n\\r]| {2}'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))"
)
_HREFS = f"regexp_extract_all({_VISIBLE}, '(?is)<a\\b[^>]*href=\"([^\"]*)\"', 1)"
_TITLE = _decoded("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")


@query("page_text", f"SELECT page_id, {_TEXT} AS text FROM pages")
def page_text(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return rows.select("page_id", P.page_text(F.col("html")).alias("text"))


@query(
    "page_links",
    f"""WITH a AS (SELECT page_id, url, unnest({_HREFS}) AS href FROM pages),
r AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || {_decoded('href')}
  ELSE 'unexpected ' || href END AS link FROM a)
SELECT page_id, url, link FROM r WHERE split_part(link, '/', 3) = regexp_extract(url, '^https?://([^/?#]+)', 1)""",
)
def page_links(spark, sf_dir):
    return P.internal_links(table(spark, sf_dir, "pages"))


@query(
    "page_facts",
    f"""SELECT page_id, {_TITLE} AS title, CAST(len(regexp_extract_all({_VISIBLE}, '(?i)<a[\\s>]')) AS INTEGER) AS links_count,
  url LIKE 'https://%' AS uses_https, regexp_matches(url, '^https?://[^/?#]+') AS is_web,
  len(list_filter(regexp_extract_all({_VISIBLE}, '(?is)<a\\b[^>]*>.*?</a\\s*>'), lambda x: regexp_matches(lower(x), 'privacy|policy|data protection'))) > 0 AS has_privacy_policy FROM pages""",
)
def page_facts(spark, sf_dir):
    pages = P.web_pages(spread(table(spark, sf_dir, "pages"), "page_id"))
    facts = P.analyze_pages(pages)
    return facts.select("page_id", "title", "links_count", F.col("security.uses_https").alias("uses_https"),
                        textfn.is_web_url(F.col("url")).alias("is_web"), "has_privacy_policy")


@query(
    "page_security_findings",
    """SELECT url AS location, 'Website not using HTTPS' AS context, 'critical' AS severity, CAST(1 AS DOUBLE) AS confidence FROM pages WHERE url NOT LIKE 'https://%'
UNION ALL SELECT url, 'Missing Strict-Transport-Security header', 'medium', CAST(1 AS DOUBLE) FROM pages
UNION ALL SELECT url, 'Missing Content-Security-Policy header', 'low', CAST(1 AS DOUBLE) FROM pages""",
)
def page_security_findings(spark, sf_dir):
    facts = table(spark, sf_dir, "pages").select("page_id", "url", P.security(F.col("url")).alias("security"))
    return P.security_findings(facts, F.col("page_id")).select("location", "context", "severity", "confidence")


@query(
    "page_policy_findings",
    f"""SELECT url AS location, 'No privacy policy link found' AS context, 'high' AS severity, 'Art. 12, Art. 13' AS gdpr_articles FROM pages
WHERE len(list_filter(regexp_extract_all({_VISIBLE}, '(?is)<a\\b[^>]*>.*?</a\\s*>'), lambda x: regexp_matches(lower(x), 'privacy|policy|data protection'))) = 0""",
)
def page_policy_findings(spark, sf_dir):
    facts = spread(table(spark, sf_dir, "pages"), "page_id").select(
        "page_id", "url", P.has_privacy_policy(F.col("html")).alias("has_privacy_policy"))
    return P.policy_findings(facts, F.col("page_id")).select(
        "location", "context", "severity", F.array_join("gdpr_articles", ", ").alias("gdpr_articles"))


@query(
    "page_pii",
    f"""WITH page_texts AS (SELECT page_id, url, {_TITLE} AS title, {_TEXT} AS text FROM pages),
{K.spans('page_texts', ['page_id', 'url', 'title'], DOCUMENT, plain=True)}
SELECT CAST(page_id AS VARCHAR) AS scan_id, url AS source, title AS location, pii_type, value AS content, confidence, {K.WEB_SEVERITY} AS severity, {K.WEB_ARTICLES} AS gdpr_articles, context FROM spans""",
)
def page_pii(spark, sf_dir):
    found = P.page_pii_findings(table(spark, sf_dir, "pages"), F.col("page_id"))
    return found.select("scan_id", "source", "location", "pii_type", "content", "confidence", "severity",
                        F.array_join("gdpr_articles", ", ").alias("gdpr_articles"), "context")


@query(
    "site_page_cap",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site FROM pages)
SELECT page_id, site FROM p QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) <= 3""",
)
def site_page_cap(spark, sf_dir):
    return P.first_pages_per_site(table(spark, sf_dir, "pages").select("page_id", "url"), 3).select("page_id", "site")


@query(
    "page_forms",
    f"""WITH {FORMS_SQL} SELECT page_id, action, method, CAST(2 AS INTEGER) AS inputs, first_name || ',' || second_name AS names,
  pii_fields, pii_fields > 0 AS collects_pii FROM pages_made""",
)
def page_forms(spark, sf_dir):
    forms = web_forms(spark, sf_dir).select("page_id", F.inline(P.forms(F.col("html"))))
    return forms.select(
        "page_id", "action", "method", F.size("inputs").alias("inputs"),
        F.array_join(F.transform("inputs", lambda i: i["name"]), ",").alias("names"),
        F.size(F.filter("inputs", lambda i: i["may_collect_pii"])).alias("pii_fields"), "collects_pii",
    )


@query(
    "page_form_findings",
    f"""WITH {FORMS_SQL}
SELECT url AS location, 'Form collecting PII without HTTPS: ' || action AS context, 'critical' AS severity FROM pages_made
  WHERE pii_fields > 0 AND NOT (CASE WHEN action = '' THEN url LIKE 'https://%' ELSE action LIKE 'https://%' END)
UNION ALL SELECT url, 'Form collecting PII: ' || pii_fields || ' fields', 'high' FROM pages_made WHERE pii_fields > 0""",
)
def page_form_findings(spark, sf_dir):
    pages = web_forms(spark, sf_dir).select("page_id", "url", P.forms(F.col("html")).alias("forms"))
    return P.form_findings(pages, F.col("page_id")).select("location", "context", "severity")


@query(
    "page_cookie_findings",
    f"""WITH {FORMS_SQL}
SELECT CAST(page_id AS VARCHAR) AS scan_id, 'Cookie: ' || cookie AS location, cookie_type || ' cookie detected' AS context,
  CASE cookie_type WHEN 'advertising' THEN 'high' ELSE 'medium' END AS severity FROM pages_made WHERE cookie_type IN ('analytics', 'advertising')
UNION ALL SELECT CAST(page_id AS VARCHAR), 'Cookie: ' || cookie, 'Cookie missing Secure flag', 'medium' FROM pages_made WHERE NOT secure""",
)
def page_cookie_findings(spark, sf_dir):
    pages = P.analyze_pages(web_forms(spark, sf_dir))
    return P.cookie_findings(pages, F.col("page_id")).select("scan_id", "location", "context", "severity")


@query(
    "cookie_classes",
    f"WITH {FORMS_SQL} SELECT cookie, cookie_type, secure, count(*) AS pages FROM pages_made GROUP BY ALL",
)
def cookie_classes(spark, sf_dir):
    cookies = web_forms(spark, sf_dir).select(F.explode("cookies").alias("c"))
    return cookies.groupBy(
        F.col("c.name").alias("cookie"), P.cookie_class(F.col("c.name")).alias("cookie_type"), F.col("c.secure").alias("secure")
    ).agg(F.count("*").alias("pages"))


@query(
    "header_findings",
    f"""WITH {FORMS_SQL}
SELECT url AS location, 'Website not using HTTPS' AS context FROM pages_made WHERE url NOT LIKE 'https://%'
UNION ALL SELECT url, 'Missing Strict-Transport-Security header' FROM pages_made WHERE NOT hsts
UNION ALL SELECT url, 'Missing Content-Security-Policy header' FROM pages_made WHERE NOT csp
UNION ALL SELECT url, 'No privacy policy link found' FROM pages_made WHERE NOT policy""",
)
def header_findings(spark, sf_dir):
    pages = P.analyze_pages(web_forms(spark, sf_dir))
    scan = F.col("page_id")
    return P.security_findings(pages, scan).unionByName(P.policy_findings(pages, scan)).select("location", "context")


# --- whole scans ---------------------------------------------------------------------------

_PAGE_SCAN_SQL = f"""page_texts AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, {_TITLE} AS title, {_TEXT} AS text FROM pages),
{K.spans('page_texts', ['page_id', 'url', 'site', 'title'], DOCUMENT, plain=True, context=False)},
web AS (SELECT site AS scan_id, pii_type, {K.WEB_SEVERITY} AS severity FROM spans
  UNION ALL SELECT regexp_extract(url, '^https?://([^/?#]+)', 1), 'OTHER', unnest(list_filter([CASE WHEN url NOT LIKE 'https://%' THEN 'critical' END,
    'medium', 'low', CASE WHEN len(list_filter(regexp_extract_all({_VISIBLE}, '(?is)<a\\b[^>]*>.*?</a\\s*>'),
      lambda x: regexp_matches(lower(x), 'privacy|policy|data protection'))) = 0 THEN 'high' END], lambda x: x IS NOT NULL)) FROM pages)"""


@query("web_scan", f"WITH {_PAGE_SCAN_SQL} SELECT scan_id, pii_type, severity, count(*) AS findings FROM web GROUP BY ALL")
def web_scan(spark, sf_dir):
    found = scan_pages(table(spark, sf_dir, "pages"), P.host(F.col("url")))
    return found.groupBy("scan_id", "pii_type", "severity").agg(F.count("*").alias("findings"))


def _web_points() -> str:
    """Points per finding on a web page: any type; contact data additionally breaks the consent rule."""
    from velum.operators.compliance import DEDUCTION, RULES

    parts = []
    for r in RULES:
        if r.threshold_count is None and (r.any_pii or r.source_types is None or "web" in r.source_types):
            test = f"pii_type IN ({', '.join(K.text(t) for t in r.pii_types)})" if r.pii_types else "true"
            parts.append(f"CASE WHEN {test} THEN {DEDUCTION[r.severity]} ELSE 0 END")
    return " + ".join(parts)


@query(
    "web_compliance",
    f"""WITH {_PAGE_SCAN_SQL}, s AS (SELECT scan_id, count(*) AS n, sum({_web_points()}) AS p FROM web GROUP BY scan_id)
SELECT scan_id, CAST(greatest(0, 100 - p) AS DOUBLE) AS compliance_score, 'non_compliant' AS status FROM s""",
)
def web_compliance(spark, sf_dir):
    """Score per site. Every finding breaks the security rule, so no site with findings complies."""
    found = scan_pages(table(spark, sf_dir, "pages"), P.host(F.col("url")))
    return compliance(found).select("scan_id", "compliance_score", "status")


@query(
    "made_page_issues",
    f"""WITH {FORMS_SQL}
SELECT page_id AS scan_id, severity, count(*) AS findings FROM (
  SELECT page_id, unnest(list_filter([CASE cookie_type WHEN 'advertising' THEN 'high' WHEN 'analytics' THEN 'medium' END,
    CASE WHEN NOT secure THEN 'medium' END,
    CASE WHEN pii_fields > 0 AND NOT (CASE WHEN action = '' THEN url LIKE 'https://%' ELSE action LIKE 'https://%' END) THEN 'critical' END,
    CASE WHEN pii_fields > 0 THEN 'high' END, CASE WHEN url NOT LIKE 'https://%' THEN 'critical' END,
    CASE WHEN NOT hsts THEN 'medium' END, CASE WHEN NOT csp THEN 'low' END, CASE WHEN NOT policy THEN 'high' END], lambda x: x IS NOT NULL)) AS severity
  FROM pages_made) GROUP BY ALL""",
)
def made_page_issues(spark, sf_dir):
    found = P.page_issue_findings(P.analyze_pages(web_forms(spark, sf_dir)), F.col("page_id"))
    return found.groupBy(F.col("scan_id").cast("long").alias("scan_id"), "severity").agg(F.count("*").alias("findings"))
