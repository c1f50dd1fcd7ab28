import json

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from velum.functions import grading
from velum.functions.patterns import BASE
from velum.operators import compliance as C
from velum.operators import detect as D
from velum.operators import diff as X
from velum.operators import findings as FN
from velum.operators import summary as S
from velum.sinks import reports as R
from velum.sources import saved

BASIC = "scan_id string, source string, source_type string, location string, pii_type string, content string, confidence double, severity string, seq int"


def findings(spark, rows, scan="s", source_type="document"):
    data = [(scan, "file.txt", source_type, loc, kind, content, conf, sev, i) for i, (loc, kind, content, conf, sev) in enumerate(rows)]
    df = spark.createDataFrame(data, BASIC).withColumn("finding_id", F.concat_ws("-", "scan_id", "seq"))
    return FN.conform(df.withColumn("context", F.lit("around")).withColumn("gdpr_articles", F.array(F.lit("Art. 6"))))


SSN_EMAIL = [("line 1", "SSN", "123-45-6789", 0.95, "critical"), ("line 2", "EMAIL", "test@example.com", 0.90, "medium")]


def one_scan(spark, scan="s"):
    return spark.createDataFrame([(scan,)], "scan_id string")


def test_golden_score(spark):
    """SSN breaks 9 rules (46 points), e-mail 7 (31): score 23."""
    f = findings(spark, SSN_EMAIL)
    per = {r.pii_type: r["count"] for r in C.violations(f).groupBy("pii_type").count().collect()}
    assert per == {"SSN": 9, "EMAIL": 7}
    row = C.compliance(f, scans=one_scan(spark)).first()
    assert (row.compliance_score, row.status, row.total_violations) == (23.0, "non_compliant", 16)
    assert {r.article for r in C.by_article(f).collect()} >= {"Art. 9", "Art. 32"}


def test_clean_and_heavy_scans(spark):
    f = findings(spark, [("l", "SSN", str(i), 0.9, "critical") for i in range(10)], scan="heavy")
    scans = spark.createDataFrame([("heavy",), ("clean",)], "scan_id string")
    got = {r.scan_id: (r.compliance_score, r.status) for r in C.compliance(f, scans=scans).collect()}
    assert got == {"heavy": (0.0, "non_compliant"), "clean": (100.0, "compliant")}


def test_counts_agree_with_violations(spark):
    rows = [(f"l{i}", "CREDIT_CARD" if i % 3 else "EMAIL", str(i), 0.9, "high") for i in range(160)]
    for kind in ("document", "web"):
        f = findings(spark, rows, source_type=kind)
        built = {(r.rule_id): r["count"] for r in C.violations(f).groupBy("rule_id").count().collect()}
        counted = {r.rule_id: r.violations for r in C.rule_counts(f).collect()}
        assert built == counted
        assert ("gdpr_art35_dpia" in built) and (("gdpr_art7_consent" in built) == (kind == "web"))


def test_threshold_is_inclusive(spark):
    for n, fires in ((99, False), (100, True)):
        f = findings(spark, [("l", "SSN", str(i), 0.9, "critical") for i in range(n)])
        assert ("gdpr_art35_dpia" in {r.rule_id for r in C.violations(f).select("rule_id").distinct().collect()}) is fires


def test_checks_can_be_evaluated(spark):
    f = findings(spark, SSN_EMAIL).withColumn("checks", F.array(F.lit("missing_https")))
    on = C.violations(f, evaluate_checks=True).filter("rule_id = 'gdpr_art32_security'").count()
    off = C.violations(f.withColumn("checks", F.array().cast("array<string>")), evaluate_checks=True)
    assert on == 2 and off.filter("rule_id = 'gdpr_art32_security'").count() == 0


def test_recommendations(spark):
    lines = {r.rank: r.line for r in C.recommendations(findings(spark, SSN_EMAIL), F.col("seq"), top=10).collect()}
    assert lines[-1] == "URGENT: Address 3 critical violations immediately"
    assert lines[0].startswith("HIGH PRIORITY: Resolve 7 ")
    assert lines[1].endswith("(affects 2 items)") and sorted(lines) == [-1, 0, *range(1, len(lines) - 1)]


def test_status_bounds(spark):
    rules = (C.Rule("r", "r", "Art. 6", "high", "do", any_pii=True),)
    got = {}
    for n in (0, 2, 3, 6, 7):
        f = findings(spark, [("l", "EMAIL", "x", 0.9, "high")] * n)
        got[n] = C.compliance(f, rules, scans=one_scan(spark)).first().status
    assert got == {0: "compliant", 2: "compliant", 3: "mostly_compliant", 6: "mostly_compliant", 7: "needs_improvement"}


def test_no_join_with_the_rules(spark):
    plan = plan_of(C.compliance(findings(spark, SSN_EMAIL)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_severity_profiles(spark):
    df = spark.createDataFrame(
        [("SSN", 0.95), ("SSN", 0.65), ("EMAIL", 0.55), ("EMAIL", 0.6), ("CRYPTO_ADDRESS", 0.9), ("DATE_OF_BIRTH", 0.9)], "t string, c double")
    rows = df.select(*[grading.severity(F.col("t"), F.col("c"), p).alias(p) for p in ("document", "web", "database")]).collect()
    assert [tuple(r) for r in rows] == [
        ("critical", "critical", "critical"), ("high", "critical", "critical"), ("medium", "high", "medium"),
        ("high", "high", "medium"), ("medium", "medium", "critical"), ("medium", "medium", "high")]


def test_findings_are_reproducible(spark):
    docs = spark.createDataFrame([(1, "a@b.com c@d.org")], "id long, text string")
    make = lambda: FN.to_findings(D.detect(docs, "text", ["id"], BASE), scan_id=F.lit("s"), source=F.col("id"))
    a, b = make().orderBy("seq").collect(), make().orderBy("seq").collect()
    assert [r.finding_id for r in a] == [r.finding_id for r in b] and len({r.finding_id for r in a}) == 2
    assert a[0].location == "Document" and make().schema.simpleString() == FN.FINDINGS_SCHEMA.simpleString()


def test_locations(spark):
    df = spark.createDataFrame([(3,), (0,), (None,)], "p int")
    assert [r.x for r in df.select(grading.location_label(F.col("p")).alias("x")).collect()] == ["Page 3", "Document", "Document"]


# --- comparison

BASELINE = [("line 1", "EMAIL", "john@example.com", 0.95, "medium"), ("line 2", "PHONE_NUMBER", "555-1234", 0.90, "medium"),
            ("line 3", "SSN", "123-45-6789", 0.98, "critical")]
CURRENT = [BASELINE[0], ("line 3", "SSN", "123-45-6789", 0.99, "critical"),
           ("line 4", "CREDIT_CARD", "4532-1234-5678-9010", 0.95, "critical")]


def test_diff(spark):
    a, b = findings(spark, BASELINE, "a"), findings(spark, CURRENT, "b")
    d = X.compare(a, b, order=F.col("seq"))
    assert X.diff_summary(d).first().asDict() == {
        "new_count": 1, "resolved_count": 1, "modified_count": 1, "unchanged_count": 1, "net_change": 0, "trend": "stable"}
    kinds = {r.pii_type: r.change_type for r in d.collect()}
    assert kinds == {"EMAIL": "unchanged", "PHONE_NUMBER": "resolved", "SSN": "modified", "CREDIT_CARD": "new"}


def test_trend(spark):
    a, b = findings(spark, BASELINE, "a"), findings(spark, BASELINE[:1], "b")
    assert X.diff_summary(X.compare(a, b, order=F.col("seq"))).first().trend == "better"
    assert X.diff_summary(X.compare(b, a, order=F.col("seq"))).first().trend == "worse"


def test_last_finding_of_a_signature_wins_even_when_hot(spark):
    rows = [("line 1", "EMAIL", "same", 0.5 + i / 10000, "medium") for i in range(3000)]
    one = X.last_per_signature(findings(spark, rows), F.col("seq")).collect()
    assert len(one) == 1 and one[0].confidence == 0.5 + 2999 / 10000
    assert "Window" not in plan_of(X.last_per_signature(findings(spark, rows), F.col("seq")))


def test_long_contents_share_a_signature(spark):
    rows = [("l", "OTHER", "x" * 50 + "a", 0.9, "low"), ("l", "OTHER", "x" * 50 + "b", 0.9, "low")]
    assert X.signatures(findings(spark, rows)).count() == 1


def test_report(spark):
    a, b = findings(spark, BASELINE, "a"), findings(spark, CURRENT, "b")
    fact = lambda i, n: spark.createDataFrame([(i, "2024-01-01T00:00:00", n)], "scan_id string, timestamp string, total_findings long")
    lines = X.report_lines(X.compare(a, b, order=F.col("seq")), fact("a", 3), fact("b", 3))
    text = [r.line for r in lines.orderBy("section", "sort_key", "part").collect()]
    assert text[0] == text[-1] == "=" * 80 and text[1] == "SCAN COMPARISON REPORT"
    assert text[text.index("NEW FINDINGS") + 2] == "  [CRITICAL] CREDIT_CARD at line 4 (confidence: 0.95)"
    assert "    Confidence: 0.98 -> 0.99" in text and "  Net Change:         +0" in text


def test_shifts(spark):
    a, b = findings(spark, BASELINE, "a"), findings(spark, CURRENT, "b")
    got = {r.severity: (r.baseline, r.current, r.percent_change) for r in X.severity_shift(a, b).collect()}
    assert got == {"medium": (2, 1, -50.0), "critical": (1, 2, 100.0)}
    assert {r.pii_type: r.status for r in X.type_shift(a, b).collect()} == {"PHONE_NUMBER": "removed", "CREDIT_CARD": "new"}


# --- counting and exports


def test_batch_statistics(spark):
    f = FN.merge(findings(spark, SSN_EMAIL[1:]), findings(spark, SSN_EMAIL[:1]).withColumn("source", F.lit("file2.txt")))
    row = S.batch_statistics(f).first()
    assert (row.total_findings, row.files_with_findings, row.critical, row.medium) == (2, 2, 1, 1)
    maps = S.scan_maps(f).first()
    assert maps.findings_by_severity == {"critical": 1, "medium": 1} and maps.total_findings == 2


def test_details_only_when_few(spark):
    row = ("l", "EMAIL", "x", 0.9, "high")
    assert S.details_if_few(findings(spark, [row] * 20), 20).count() == 20
    assert S.details_if_few(findings(spark, [row] * 21), 20).count() == 0


def test_cooccurrence_brute_force(spark):
    docs = spark.createDataFrame(
        [(0, "a@b.com 10.0.0.1"), (1, "a@b.com c@d.com 10.0.0.1 123-45-6789"), (2, "a@b.com"), (3, "none")], "id long, text string")
    rows = S.cooccurrence(D.with_detections(docs, "text", BASE)).collect()
    assert {(r.type_a, r.type_b): r.texts for r in rows} == {("EMAIL", "IP_ADDRESS"): 2, ("EMAIL", "SSN"): 1, ("IP_ADDRESS", "SSN"): 1}


def test_top_per_group_with_a_hot_group(spark):
    df = spark.range(0, 4000, 1, 11).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(1)).alias("g"))
    got = {(r.g, r.id) for r in S.top_per_group(df, ["g"], [F.col("id").desc()], 7).collect()}
    want, groups = set(), {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.id)
    for g, ids in groups.items():
        want |= {(g, i) for i in sorted(ids, reverse=True)[:7]}
    assert got == want
    assert "WindowGroupLimit" in plan_of(S.top_per_group(df, ["g"], [F.col("id").desc()], 7))


def test_csv_export(spark, tmp_path):
    f = findings(spark, [("l", "EMAIL", "x", 0.9, "medium")]).withColumn("context", F.lit("c" * 101)).withColumn("page_number", F.lit(0))
    row = R.csv_rows(f).first()
    assert row.context == "c" * 100 + "..." and row.confidence == "0.90" and row.page_number == "" and len(row) == 12
    assert R.sheet_rows(f).first().Context == "c" * 100
    R.write_csv(R.csv_rows(f), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert len(back) == 1 and back[0].gdpr_articles == "Art. 6"


def test_workbook_folders(spark, tmp_path):
    f = findings(spark, SSN_EMAIL)
    scans = spark.createDataFrame([("s", "a.txt", "document", "completed", 1.5, 2)],
                                  "scan_id string, source string, source_type string, status string, duration_seconds double, total_findings long")
    R.write_workbook(f, scans, str(tmp_path / "book"))
    assert {p.name for p in (tmp_path / "book").iterdir()} == {"summary", "findings", "by_severity", "by_type"}
    rows = spark.read.option("header", True).csv(str(tmp_path / "book" / "summary")).orderBy("section", "rank", "key").collect()
    assert [(r.key, r.value) for r in rows[:3]] == [("Source", "a.txt"), ("Type", "document"), ("Status", "completed")]


def test_saved_findings_hide_values(spark, tmp_path):
    R.save_findings(findings(spark, SSN_EMAIL), str(tmp_path / "scan"))
    back = saved.read_findings(spark, str(tmp_path / "scan"))
    assert back.schema == FN.FINDINGS_SCHEMA and {r.content for r in back.collect()} == {"[REDACTED]"}


def test_scan_documents(spark, tmp_path):
    doc = {"scan_id": "s1", "source": "a", "source_type": "document", "findings": [
        {"id": "f1", "source": "a", "location": "Page 1", "pii_type": "EMAIL", "confidence": 0.9, "severity": "high", "gdpr_articles": ["Art. 6"]}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    row = saved.read_scan_documents(spark, str(tmp_path / "one.json")).first()
    assert (row.scan_id, row.finding_id, row.gdpr_articles) == ("s1", "f1", ["Art. 6"])


def test_article_details(spark):
    df = spark.createDataFrame([("Art. 7",), ("Art. 99",)], "a string")
    rows = C.article_details(df, "a").collect()
    assert rows[0].article_name == "Conditions for consent" and len(rows[0].key_points) == 4
    assert rows[1].article_name is None and rows[1].key_points is None


@pytest.mark.parametrize("scans", [True, False])
def test_multi_scan_summary(spark, scans):
    f = findings(spark, SSN_EMAIL)
    every = spark.createDataFrame([("s",), ("empty",)], "scan_id string") if scans else None
    got = {(r.section, r.key): r.findings for r in S.multi_scan_summary(f, every).collect()}
    assert got[("total", "all")] == 2 and got[("type", "SSN")] == 1 and got.get(("scan", "empty")) == (0 if scans else None)


def test_top_n_in_slices(spark):
    from velum import session

    df = spark.range(0, 5000, 1, 13).select(((F.col("id") * 7919) % 5003).alias("k"))
    plain = [r.k for r in session.top_n(df, [F.col("k").desc()], 50).collect()]
    large = session.top_n(df, [F.col("k").desc()], 50, slices=4)
    assert [r.k for r in large.collect()] == plain == sorted((r.k for r in df.collect()), reverse=True)[:50]
    assert "WindowGroupLimit" in plan_of(large)


def test_stored_signatures_are_compared_without_a_shuffle(spark, tmp_path):
    """Null and empty keys stay apart, the last finding wins, values are not on disk, and neither side is dealt anew."""
    schema = "source string, location string, pii_type string, content string, severity string, confidence double, seq int"
    old = [("a", None, "EMAIL", "x@y.zz", "low", 0.5, 1), ("a", None, "EMAIL", "x@y.zz", "high", 0.5, 2), ("a", "", "EMAIL", "x@y.zz", "low", 0.5, 1),
           ("b", "p", "SSN", "123-45-6789", "high", 0.9, 1)]
    new = [("a", None, "EMAIL", "x@y.zz", "high", 0.5, 1), ("b", "p", "SSN", "123-45-6789", "high", 0.8, 1), ("c", "1", "SSN", "23", "low", 0.1, 1)]
    keys, tables, frames = ("source", "location", "pii_type", "content"), [], []
    for name, rows in (("stored_old", old), ("stored_new", new)):
        frames.append(spark.createDataFrame(rows, schema))
        R.store_signatures(frames[-1], name, str(tmp_path / name), order=F.col("seq"), keys=keys, buckets=4)
        tables.append(spark.table(name))
    try:
        made = X.compare_stored(*tables)
        assert "Exchange" not in plan_of(made) and "SortMergeJoin" in plan_of(made)
        plain = X.compare(*frames, order=F.col("seq"), keys=keys)
        rest = ["pii_type", "baseline_severity", "baseline_confidence", "current_severity", "current_confidence", "change_type"]
        want = plain.select(X.signature_digest(keys), *rest)
        assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert sorted(r.change_type for r in made.collect()) == ["modified", "new", "resolved", "unchanged"]
        assert tables[0].columns == ["signature", "pii_type", "severity", "confidence"]
        with pytest.raises(Exception, match="ALREADY_EXISTS"):
            R.store_signatures(frames[0], "stored_old", str(tmp_path / "again"), order=F.col("seq"), keys=keys)
        empty = X.compare_stored(tables[0], tables[1].filter("false"))
        assert {r.change_type for r in empty.collect()} == {"resolved"}
    finally:
        for name in ("stored_old", "stored_new"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
