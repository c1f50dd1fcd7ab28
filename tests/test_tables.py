import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from velum.functions import text as T
from velum.operators import tables as TB


def test_column_names(spark):
    rows = [("users", "email_address", "string"), ("employees", "ssn", "string"), ("products", "product_id", "int"),
            ("users", "Mailing_Address", "string"), ("staff", "DOB", "date")]
    cols = spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
    got = {r.location: (r.pii_type, r.severity, r.confidence) for r in TB.scan_column_names(cols, F.lit("db")).collect()}
    assert got == {
        "users.email_address": ("EMAIL", "medium", 0.75),
        "employees.ssn": ("SSN", "critical", 0.75),
        "users.Mailing_Address": ("LOCATION", "medium", 0.75),
        "staff.DOB": ("DATE_OF_BIRTH", "high", 0.75),
    }


@pytest.mark.parametrize("names, found", [([], 1), (["users"], 1), (["audit_log"], 0), (["Change_HISTORY"], 0)])
def test_audit_tables(spark, names, found):
    df = spark.createDataFrame([(n,) for n in names], "table_name string")
    assert TB.audit_findings(TB.check_audit_tables(df), F.lit("db")).count() == found


@pytest.mark.parametrize("url, ok", [
    ("postgresql://u:p@h/db", True), ("mysql+pymysql://h/db", True), ("sqlite:///x.db", True), ("mssql://h", True),
    ("invalid://connection", False), ("not-a-connection-string", False), ("", False)])
def test_connection_strings(spark, url, ok):
    assert spark.range(1).select(T.is_database_url(F.lit(url)).alias("ok")).first().ok is ok


def test_profile_threshold(spark):
    rows = [(f"a{i}@b.com" if i < 5 else "x", "10.0.0.1" if i < 4 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "c1 string, c2 string")
    got = {(r.column_name, r.pii_type): (r.hits, r["values"], r.percent) for r in TB.profile_columns(df, "t").collect()}
    assert got[("c1", "EMAIL")] == (5, 100, 5.0) and got[("c2", "IP_ADDRESS")] == (4, 4, 100.0)
    found = TB.scan_column_contents(TB.profile_columns(df, "t"), F.lit("db")).collect()
    assert {r.location for r in found} == {"t.c1", "t.c2"} and {r.confidence for r in found} == {0.85}


def test_values_do_not_straddle(spark):
    """Two neighbouring values must not make one hit together."""
    df = spark.createDataFrame([("4532-1488",), ("0343-6467",)], "c string")
    assert TB.profile_columns(df, "t").count() == 0


def test_profile_aggregates_before_the_shuffle(spark, sf):
    plan = plan_of(TB.profile_columns(spark.read.parquet(f"{sf}/customer.parquet"), "customer"))
    assert "partial_sum" in plan or "HashAggregate" in plan
    assert plan.count("Scan parquet") <= 2  # the one scan, listed in tree and details


def test_samples(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert sorted(r.k for r in TB.sample(df, "k", 10, strategy="top").collect()) == list(range(10))
    assert sorted(r.k for r in TB.sample(df, "k", 10, strategy="bottom").collect()) == list(range(4990, 5000))
    a, b = ({r.k for r in TB.sample(df.repartition(n), "k", 100).collect()} for n in (3, 7))
    assert a == b and len(a) == 100 and a != set(range(100))
    assert {r.k for r in TB.sample(df, "k", 100, seed=1).collect()} != a
    assert TB.sample(df, "k", fraction=2.0, rows=9000).count() == 5000
    assert TB.sample(df, "k", fraction=-1.0).count() == 0
    assert "TakeOrderedAndProject" in plan_of(TB.sample(df, "k", 100))


def test_database_scan(spark):
    users = spark.createDataFrame([(1, "a@b.com"), (2, "c@d.com")], "id int, email string")
    rows = TB.scan_database({"users": users}, "sqlite:///x.db", {"users": "id"}).collect()
    got = {(r.location, r.pii_type, r.confidence) for r in rows}
    assert got == {("users.email", "EMAIL", 0.75), ("users.email", "EMAIL", 0.85),
                   ("database_schema", "OTHER", 0.60), ("database_schema", "OTHER", 0.70)}
    assert {r.scan_id for r in rows} == {"sqlite:///x.db"} and len({r.finding_id for r in rows}) == 4


def test_rows_as_text(spark):
    df = spark.createDataFrame([(1, " a ", 5, None), (2, None, None, ""), (3, "b", None, "c")], "n int, x string, y int, z string")
    assert [r.line for r in TB.rows_as_text(df, ["x", "y", "z"], row_number="n").orderBy("n").collect()] == ["a\t5", "b\tc"]
    rows = TB.rows_as_text(df, ["x", "y", "z"], structured=True, row_number="n").orderBy("n").collect()
    assert [r.line for r in rows] == ["Row 2: x: a | y: 5", "Row 4: x: b | z: c"]
    assert TB.header_line(["x", "y"]) == "Headers: x, y"


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_row_numbers(spark, ranges):
    """Also with a third of the keys close together."""
    keys = [i * 1000 for i in range(200)] + list(range(1, 100))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = {r.k: r.row_number for r in TB.number_rows(df, "k", ranges).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_row_numbers_of_text_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert {r.k: r.row_number for r in TB.number_rows(df, "k").collect()} == {"a": 1, "b": 2, "c": 3}
