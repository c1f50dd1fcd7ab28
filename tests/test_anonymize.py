import hashlib

import pytest
from pyspark.sql import functions as F

from velum.functions import masking as M
from velum.functions.patterns import BASE, DOCUMENT
from velum.functions.spans import DETECTIONS
from velum.operators import anonymize as A
from velum.operators import detect as D

VALUES = [
    ("EMAIL", "mask", "john.doe@example.com", "j***@example.com"),
    ("EMAIL", "mask", "j@example.com", "***@***.com"),
    ("EMAIL", "mask", "nothing", "***@***.com"),
    ("PHONE_NUMBER", "mask", "(555) 123-4567", "***-***-4567"),
    ("PHONE_NUMBER", "mask", "123", "***-***-****"),
    ("CREDIT_CARD", "mask", "4532-1234-5678-9010", "****-****-****-9010"),
    ("CREDIT_CARD", "mask", "12", "****-****-****-****"),
    ("OTHER", "mask", "abcd", "****"),
    ("OTHER", "mask", "abcde", "a***e"),
    ("OTHER", "mask", "", ""),
    ("EMAIL", "redact", "john.doe@example.com", "[REDACTED_EMAIL]"),
    ("PERSON", "generalize", "John Smith", "[Person]"),
    ("IBAN", "generalize", "x", "[IBAN]"),
    ("OTHER", "suppress", "sensitive", ""),
    ("EMAIL", "synthetic", "any", "user@example.com"),
    ("IBAN", "synthetic", "any", "[SYNTHETIC_IBAN]"),
    ("SSN", "hash", "sensitive data", "[HASH:1d08c598430d2d8d]"),
    ("SSN", "encrypt", "any", "[SSN]"),
]


def test_values(spark):
    df = spark.createDataFrame(VALUES, "t string, s string, v string, want string")
    got = df.select("*", M.apply_strategy(F.col("v"), F.col("t"), F.col("s")).alias("got")).collect()
    assert [(r.t, r.s, r.v, r.got) for r in got if r.got != r.want] == []


def test_preferred_strategy_and_override(spark):
    df = spark.createDataFrame([("SSN",), ("IBAN",), ("EMAIL",)], "t string")
    plain = [r.s for r in df.select(M.strategy_for(F.col("t"), "redact").alias("s")).collect()]
    changed = [r.s for r in df.select(M.strategy_for(F.col("t"), "redact", {"EMAIL": "hash"}).alias("s")).collect()]
    assert plain == ["hash", "redact", "mask"] and changed == ["hash", "redact", "hash"]


def test_encryption_can_be_undone(spark):
    key = F.lit("0123456789abcdef")
    df = spark.range(1).select(M.apply_strategy(F.lit("secret"), F.lit("SSN"), F.lit("encrypt"), key).alias("e"))
    assert df.select(F.aes_decrypt(F.unbase64("e"), key).cast("string").alias("d")).first().d == "secret"


def found(spark, texts, patterns=BASE):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return D.with_detections(df, "text", patterns)


def test_by_value_and_by_span(spark):
    texts = ["Contact john.doe@example.com or 555-123-4567, again john.doe@example.com", "nothing here", "ssn 123-45-6789"]
    rows = found(spark, texts).select(
        "id", A.text_by_value(F.col("text"), F.col("detections")).alias("v"), A.text_by_span(F.col("text"), F.col("detections")).alias("s")
    ).orderBy("id").collect()
    digest = hashlib.sha256(b"123-45-6789").hexdigest()[:16]
    want = ["Contact j***@example.com or ***-***-4567, again j***@example.com", "nothing here", f"ssn [HASH:{digest}]"]
    assert [r.v for r in rows] == want and [r.s for r in rows] == want


def test_no_value_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rows = D.with_detections(docs, "text", BASE).select(
        "detections", A.text_by_value(F.col("text"), F.col("detections"), "redact", {"EMAIL": "redact", "CREDIT_CARD": "redact"}).alias("v")).collect()
    assert all(d.value not in r.v for r in rows for d in r.detections)


def test_span_replacement_against_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rows = D.with_detections(docs, "text", DOCUMENT).select(
        "text", D.resolve_overlaps(F.col("detections")).alias("kept"),
        A.text_by_span(F.col("text"), F.col("detections"), "redact", {t: "redact" for t in M.STRATEGY_BY_TYPE}).alias("s")).collect()
    for r in rows:
        out, pos = [], 0
        for d in r.kept:
            out += [r.text[pos:d.start], f"[REDACTED_{d.pii_type}]"]
            pos = d.end
        assert r.s == "".join(out) + r.text[pos:]


def test_empty_values_are_skipped(spark):
    df = spark.range(1).select(
        F.lit("abc").alias("text"),
        F.array(F.struct(F.lit("OTHER").alias("pii_type"), F.lit("").alias("value"))).alias("detections"))
    assert df.select(A.text_by_value(F.col("text"), F.col("detections")).alias("v")).first().v == "abc"


def test_columns(spark):
    df = spark.createDataFrame([("Ann Lee", "ann@x.org", "555-123-4567", 7, 0), ("", None, "1", 8, 5)],
                               "name string, email string, phone string, product_id int, card int")
    rows = A.anonymize_columns(df, ["email", "phone", "name", "card", "missing"]).collect()
    assert rows[0].asDict() == {"name": "A*****e", "email": "a***@x.org", "phone": "***-***-4567", "product_id": 7, "card": "0"}
    assert rows[1].asDict() == {"name": "", "email": None, "phone": "***-***-****", "product_id": 8, "card": "****-****-****-****"}


@pytest.mark.parametrize("name, kind", [
    ("email_addr", "EMAIL"), ("Phone", "PHONE_NUMBER"), ("social_security", "SSN"), ("card_no", "CREDIT_CARD"),
    ("first_name", "PERSON"), ("home_address", "LOCATION"), ("password", "OTHER"), ("colour", "OTHER")])
def test_field_names(spark, name, kind):
    assert spark.range(1).select(M.type_from_field_name(F.lit(name)).alias("k")).first().k == kind


def test_replacement_map_last_type_wins(spark):
    df = spark.createDataFrame([("a@b.com", "EMAIL", 1), ("a@b.com", "OTHER", 2), ("x", "SSN", 3)], "content string, pii_type string, seq int")
    got = {r.value: r.replacement for r in A.replacement_map(df, F.col("seq")).collect()}
    assert got["a@b.com"] == "" and got["x"].startswith("[HASH:")


def test_many_values_at_once_give_the_sequential_text(spark, monkeypatch):
    """Random texts whose values touch, contain and create each other, against one replacement after another."""
    import random

    from velum.operators import anonymize as A

    def new(v):
        return v[::-1] + ("" if len(v) > 4 else "zz")

    monkeypatch.setattr(A, "MANY", 2)
    monkeypatch.setattr(A, "_replacement", lambda d, *_: F.concat(F.reverse(d["value"]), F.when(F.length(d["value"]) > 4, "").otherwise("zz")))
    rows, want = [], []
    for seed in range(1200):
        pick = random.Random(seed)
        letters = ("ab", "abcdefghij", "abcdefghijklmnopqrstuvwxyz0123456789")[seed % 3]
        text, hits = "", []
        for _ in range(pick.randint(3, 12)):
            text += "".join(pick.choice(letters + " 🙂") for _ in range(pick.randint(0, 5)))
            value = "".join(pick.choice(letters) for _ in range(pick.randint(3, 9)))
            hits.append(("EMAIL", "E", len(text), len(text) + len(value), value, 0.5))
            text += value
        text += "".join(pick.choice(letters) for _ in range(pick.randint(0, 5)))
        pick.shuffle(hits)
        done = text
        for value in dict.fromkeys(h[4] for h in hits):
            done = done.replace(value, new(value))
        rows.append((seed, text, hits))
        want.append(done)
    df = spark.createDataFrame(rows, f"i int, t string, d {DETECTIONS}")
    got = df.select("i", A.text_by_value(F.col("t"), F.col("d"), placed=True).alias("g")).orderBy("i").collect()
    assert [r.g for r in got] == want
    pairs = F.array_distinct(F.transform("h", lambda h: F.struct(h["value"].alias("value"), h["new"].alias("new"))))
    hits = F.transform("d", lambda d: F.struct(d["start"], d["end"], d["value"], A._replacement(d).alias("new")))
    fast = df.withColumn("h", F.array_sort(hits)).withColumn("p", pairs).select(A._at_once(F.col("t"), F.col("h"), F.col("p")).isNotNull().alias("f"))
    assert 200 < fast.filter("f").count() < 1100
