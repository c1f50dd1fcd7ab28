import datetime as dt
import json

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from velum.functions.patterns import BASE, Pattern
from velum.functions.spans import matches_of
from velum.operators import audit as AU
from velum.operators import detect as D
from velum.operators import enrich as E
from velum.operators import findings as FN
from velum.plugins import Detector, Reader, Registry
from velum.session import scratch_dir
from velum.sinks import reports as R
from velum.sources import files as FS
from velum.sources import saved
from velum.streaming import streams as ST

# --- audit

ROWS = [("scan_started", "user1", "started"), ("scan_completed", "user1", "success"), ("pii_detected", "user2", "success")]


def log(spark, rows=ROWS):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(hours=i), e, u, "r", "a", r, {"n": str(i)}) for i, (e, u, r) in enumerate(rows)]
    return spark.createDataFrame(data, AU.AUDIT_SCHEMA)


def test_audit_query(spark):
    df = log(spark)
    assert AU.query(df).count() == 3
    assert AU.query(df, event="scan_started").count() == 1
    assert AU.query(df, user="user1").count() == 2
    at = F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    assert AU.query(df, start=at, end=at).count() == 1
    many = log(spark, ROWS[:1] * 10)
    assert [r.details["n"] for r in AU.query(many, limit=5).collect()] == ["0", "1", "2", "3", "4"]


def test_audit_summary(spark):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    got = {(r.kind, r.key): r["count"] for r in AU.summary(log(spark), now).collect()}
    assert got == {("total", "all"): 3, ("event", "scan_started"): 1, ("event", "scan_completed"): 1, ("event", "pii_detected"): 1,
                   ("user", "user1"): 2, ("user", "user2"): 1, ("result", "started"): 1, ("result", "success"): 2}
    late = {(r.kind, r.key): r["count"] for r in AU.summary(log(spark), now, hours=11).collect()}
    assert late[("total", "all")] == 2


def test_audit_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    scans = spark.createDataFrame([("s1", "a.txt", "document", 3, 1.5)],
                                  "scan_id string, source string, source_type string, total_findings long, duration_seconds double")
    moment = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    requests = spark.createDataFrame([("u", "r", "read", "no right")], "user string, resource string, action string, reason string")
    runs = spark.createDataFrame([("s1", "mask", 3, "csv", "/out", 88.5, 4)],
                                 "scan_id string, strategy string, pii_count int, format string, destination string, compliance_score double, total_violations long")
    for entry in (AU.scan_started(scans, ts=moment), AU.scan_completed(scans, ts=moment), AU.access_granted(requests, ts=moment),
                  AU.access_denied(requests, ts=moment), AU.anonymization(runs, ts=moment), AU.export(runs, ts=moment),
                  AU.compliance_check(runs, ts=moment)):
        R.append_audit(entry, path)
    back = {r.event: r for r in saved.read_audit_log(spark, path).collect()}
    assert set(back) == set(AU.AUDIT_EVENTS) - {"scan_failed", "pii_detected", "config_changed"}
    assert back["access_denied"].details == {"reason": "no right"} and back["access_denied"].result == "denied"
    assert back["scan_started"].timestamp == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert back["compliance_check"].details["compliance_score"] == "88.5"


def test_blank_log_lines_are_skipped(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"event": "export", "user": "u"}\n\n   \n{"event": "export", "user": "v"}\n')
    assert saved.read_audit_log(spark, str(tmp_path / "log.json")).count() == 2


def test_history(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(50)], "ts long, event_type string")
    assert [r.ts for r in AU.history(df, ["ts"], last=3).collect()] == [47, 48, 49]
    assert [r.ts for r in AU.history(df, ["ts"], event_type="b", last=2).collect()] == [44, 48]
    assert [r.ts for r in AU.history(df, ["ts"], event_type="b", last=100, keep=10).collect()] == [40, 44, 48]
    per = AU.history_per_type(df, ["ts"], last=2).collect()
    assert sorted((r.event_type, r.ts) for r in per) == [("a", 47), ("a", 49), ("b", 44), ("b", 48)]


# --- files


def test_collect_files(spark, tmp_path):
    for name in ("a.txt", "b.TXT", "c.pdf", "d.py", "e.json", "sub/f.eml", "sub/deep/g.Text"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    every = {(r.path.rsplit("/", 1)[1], r.kind) for r in FS.collect_files(spark, str(tmp_path)).select("path", "kind").collect()}
    assert every == {("a.txt", "text"), ("b.TXT", "text"), ("c.pdf", "pdf"), ("f.eml", "eml"), ("g.Text", "text")}
    assert FS.collect_files(spark, str(tmp_path), recursive=False).count() == 3


def test_text_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("né 😀".encode())
    (tmp_path / "l.txt").write_bytes("né".encode("latin-1"))
    (tmp_path / "e.txt").write_bytes(b"")
    sections = FS.read_text_files(FS.collect_files(spark, str(tmp_path)))
    rows = {r.source: (r.text, r.meta["encoding"]) for r in sections.collect()}
    # Spark lists no rows for empty files; like a blank text they have no findings.
    assert rows == {"u.txt": ("né 😀", "utf-8"), "l.txt": ("né", "latin-1")}
    assert D.detect(sections, "text", ["source"]).filter("source = 'e.txt'").count() == 0


MAIL = b"""From: Ann <ann@example.com>
To: bob@example.com
Subject: Hello
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="XX"

--XX
Content-Type: text/plain; charset="utf-8"

My number is 555-123-4567.
--XX
Content-Type: text/html; charset="utf-8"

<p>Caf&eacute; <b>IP</b> 10.0.0.1</p>
--XX
Content-Type: text/plain; name="secret.txt"
Content-Disposition: attachment; filename="secret.txt"

attached@example.com
--XX--
"""


def test_mail(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(MAIL)
    (tmp_path / "plain.eml").write_bytes(b"From: x@y.org\nTo: z@y.org\nCc: w@y.org\nSubject: S\n\n<b>kept</b> body\n")
    rows = {r.source: r for r in FS.read_mail_files(FS.collect_files(spark, str(tmp_path))).collect()}
    m = rows["m.eml"]
    lines = m.text.split("\n")
    assert lines[:4] == ["From: Ann <ann@example.com>", "To: bob@example.com", "Subject: Hello", ""]
    assert "My number is 555-123-4567." in lines and "Café IP 10.0.0.1" in lines
    assert "attached@example.com" not in m.text and m.meta["attachments"] == "secret.txt"
    assert rows["plain.eml"].text.startswith("From: x@y.org\nTo: z@y.org\nCc: w@y.org\nSubject: S\n\n<b>kept</b> body")
    hits = D.detect(FS.read_folder(spark, str(tmp_path)), "text", ["source"], BASE)
    assert {r.pii_type for r in hits.filter("source = 'm.eml'").collect()} == {"EMAIL", "PHONE_NUMBER", "IP_ADDRESS"}


def test_mails_stay_one_row(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(MAIL)
    assert "Exchange" not in plan_of(FS.read_mail_files(FS.collect_files(spark, str(tmp_path))))
    assert FS.failed_mails(FS.collect_files(spark, str(tmp_path))).count() == 0


def test_unsupported_files(spark):
    df = spark.createDataFrame([("/a/b.txt",), ("/a/b.py",), ("/a/none",)], "path string")
    assert {(r.path, r.error) for r in FS.unsupported(df).collect()} == {
        ("/a/b.py", "Unsupported file type: .py"), ("/a/none", "Unsupported file type: ")}


# --- streams


def feed(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_equals_batch(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    hits = ST.stream_detect(stream, "text", ["doc_id"], BASE)
    ST.run_to_table(hits, out, state).awaitTermination()
    want = D.detect(spark.read.parquet(f"{sf}/documents.parquet"), "text", ["doc_id"], BASE)
    got = spark.read.parquet(out)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 0


def test_windows_close_after_the_watermark(spark, tmp_path):
    t = dt.datetime
    rows = [(t(2024, 1, 1, 1), "a"), (t(2024, 1, 1, 23), "a"), (t(2024, 1, 2, 5), "b"), (t(2024, 1, 3, 0, 30), "a")]
    stream = feed(spark, tmp_path, [rows], "ts timestamp, event_type string")
    out = str(tmp_path / "out")
    ST.run_to_table(ST.event_counts(stream), out, str(tmp_path / "state")).awaitTermination()
    got = {(r.window_start.day, r.event_type): r.events for r in spark.read.parquet(out).collect()}
    # 2 January ends at 00:00 of the 3rd, the watermark is at 23:30 of the 2nd: still open.
    assert got == {(1, "a"): 2}


def test_duplicates(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    stream = feed(spark, tmp_path, [[(t, "x"), (t, "x"), (t, "y")], [(t + dt.timedelta(minutes=5), "x")]], "ts timestamp, id string")
    out = str(tmp_path / "out")
    ST.run_to_table(ST.drop_duplicates(stream, "id"), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["x", "y"]


def test_one_failing_handler_does_not_stop_the_others(spark):
    got = []

    def good(events, epoch):
        got.append((epoch, events.count()))

    def bad(events, epoch):
        raise RuntimeError

    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "event_type string")
    ST.route({"a": [bad, good], "b": [good], "c": [bad]})(batch, 7)
    assert got == [(7, 2), (7, 1)]


def test_violation_events(spark):
    df = spark.createDataFrame([("s", "r", "Art. 6", "high", "d")], "scan_id string, rule_id string, article string, severity string, description string")
    row = ST.violation_events(df, source="engine").first()
    assert (row.event_type, row.source, row.data["rule_id"], row.correlation_id) == ("compliance.violation_detected", "engine", "r", None)
    assert row.event_type in AU.EVENT_TYPES


# --- plug-ins and enrichment


def test_registry(spark):
    digits, words = Pattern("DIGITS", "OTHER", r"\d+", 0.9), Pattern("WORDS", "OTHER", "[a-z]+", 0.8)
    reg = Registry()
    reg.register(Detector("low", lambda t: matches_of(t, digits), ["OTHER"], priority=1))
    reg.register(Detector("high", lambda t: matches_of(t, words), ["OTHER"], priority=5))
    reg.register(Reader("csv", lambda s, p: s.read.csv(p), "document", [".csv"]))
    df = spark.createDataFrame([("ab 12",)], "t string")

    def kinds():
        return [d.entity_type for d in df.select(reg.detections(F.col("t")).alias("d")).first().d]

    assert kinds() == ["WORDS", "DIGITS"]
    assert reg.disable("high") and kinds() == ["DIGITS"] and not reg.disable("none")
    assert reg.enable("high") and reg.unload("high") and not reg.unload("high") and kinds() == ["DIGITS"]
    assert reg.reader_for(".CSV").name == "csv" and [p["name"] for p in reg.listing()] == ["low", "csv"]
    reg.unload_all()
    assert kinds() == [] and reg.reader_for(".csv") is None


def some_findings(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com or c@d.org from 10.0.0.1")], "id long, text string")
    return FN.to_findings(D.detect(docs, "text", ["id"], BASE), scan_id=F.lit("s"), source=F.col("id"))


def test_enrichment_never_sees_values(spark):
    prompts = some_findings(spark).select(E.classify_prompt().alias("p")).collect()
    assert all("Value: [REDACTED]" in r.p for r in prompts)


def test_enrichment_without_usable_reply_changes_nothing(spark):
    def broken(prompts):
        raise RuntimeError("no model")

    for predict in (broken, lambda prompts: ["nonsense"] * len(prompts), lambda prompts: ['{"confidence": 7, "sensitivity": "odd", "violations": []}'] * len(prompts)):
        before = some_findings(spark)
        after = E.enrich(before, predict).select(*before.columns)
        assert sorted(map(str, after.collect())) == sorted(map(str, before.collect()))


def test_enrichment_merges(spark):
    def model(prompts):
        return [json.dumps({"confidence": 0.5, "sensitivity": "LOW", "violations": [{"article": "Art. 17"}], "reasoning": "why",
                            "recommended_strategy": "hash", "implementation": "salt"}) for _ in prompts]

    for r in E.enrich(some_findings(spark), model).collect():
        assert r.confidence == 0.9 and r.severity == "low" and r.gdpr_articles == ["Art. 17"] and r.gdpr_reasoning == "why"
        assert r.anonymization_strategy == "hash" and r.recommendation.endswith("\n\nSuggested approach: salt")


def test_cache_asks_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.write_text("")

    def model(prompts):
        with open(asked, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(f"p{i % 3}",) for i in range(30)], "prompt string").withColumn("key", E.prompt_key(F.col("prompt")))
    cache = str(tmp_path / "cache")
    first = E.cached_answers(df, model, cache).collect()
    more = df.union(spark.createDataFrame([("new",)], "prompt string").withColumn("key", E.prompt_key(F.col("prompt"))))
    second = E.cached_answers(more, model, cache, slots=2).collect()
    assert sorted(asked.read_text().split()) == ["new", "p0", "p1", "p2"]
    assert len(first) == 3 and sorted(r.reply for r in second) == ["NEW", "P0", "P1", "P2"]


def test_scratch_is_shared(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(root) and scratch_dir(spark, "x") != scratch_dir(spark, "x")


@pytest.mark.parametrize("name", ["file.PDF", "a.b.txt", "none"])
def test_extension(spark, name):
    from velum.functions.text import extension

    want = "." + name.rsplit(".", 1)[1].lower() if "." in name else ""
    assert spark.range(1).select(extension(F.lit(name)).alias("e")).first().e == want
