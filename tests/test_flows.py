"""Whole scans from input to report."""

from conftest import plan_of
from pyspark.sql import functions as F

from velum import flows
from velum.functions.patterns import Pattern
from velum.functions.spans import matches_of
from velum.operators import anonymize as A
from velum.operators import compliance as C
from velum.operators import pages as P
from velum.plugins import Detector, Reader, Registry
from velum.sinks import reports as R
from velum.sources import saved


def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Write to ann@example.com or call 555-123-4567.")
    (tmp_path / "sub" / "b.TXT").write_text("SSN 123-45-6789, ticket T-77")
    (tmp_path / "m.eml").write_bytes(b"From: x@y.org\nTo: z@y.org\nSubject: S\n\nserver 10.0.0.1\n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.py").write_text("ignored@example.com")
    (tmp_path / "empty.txt").write_text("")
    return str(tmp_path)


def test_folder_to_report(spark, tmp_path):
    scan = flows.scan_folder(spark, folder(tmp_path), scan_id="f1")
    rows = scan.findings.collect()
    assert {(r.source, r.pii_type) for r in rows} == {
        ("a.txt", "EMAIL"), ("a.txt", "PHONE_NUMBER"), ("b.TXT", "SSN"), ("m.eml", "EMAIL"), ("m.eml", "IP_ADDRESS")}
    assert {r.location for r in rows} == {"Document"} and {r.scan_id for r in rows} == {"f1"}
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in scan.errors.collect()] == [("c.pdf", "No reader for .pdf")]

    saved_to = str(tmp_path / "saved")
    R.save_findings(scan.findings, saved_to)
    again = saved.read_findings(spark, saved_to)
    direct, loaded = C.compliance(scan.findings).first(), C.compliance(again).first()
    assert direct == loaded and direct.status == "non_compliant"
    assert {r.scan_id for r in A.anonymize_findings(scan.findings).collect()} == {"f1_anonymized"}


def test_flat_folder(spark, tmp_path):
    scan = flows.scan_folder(spark, folder(tmp_path), recursive=False)
    assert "SSN" not in {r.pii_type for r in scan.findings.collect()}


def test_folder_with_plugins(spark, tmp_path):
    def read_notes(session, path):
        rows = [("notes", "notes/1", "ticket T-99", None, {})]
        return session.createDataFrame(rows, "source string, section_id string, text string, page_number int, meta map<string,string>")

    ticket = Pattern("TICKET", "OTHER", r"T-\d+", 0.9)
    registry = Registry()
    registry.register(Detector("ticket", lambda t: matches_of(t, ticket), ["OTHER"]))
    registry.register(Reader("notes", read_notes, "document", [".pdf"]))
    scan = flows.scan_folder(spark, folder(tmp_path), registry=registry)
    found = {(r.source, r.content) for r in scan.findings.collect() if r.pii_type == "OTHER"}
    assert found == {("b.TXT", "T-77"), ("notes", "T-99")} and scan.errors.count() == 0


def test_pages(spark):
    rows = [(1, "http://a.com/1", '<title>T</title><form action="/x"><input name="email"></form><p>a@b.com</p>'),
            (2, "https://a.com/2", '<a href="/privacy">Privacy</a>'), (3, "ftp://a.com/3", "c@d.com")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = flows.scan_pages(pages, P.host(F.col("url")))
    first = {(r.severity, r.source) for r in found.filter("location = 'http://a.com/1'").collect()}
    assert first == {("critical", "Website Form"), ("high", "Website Form"), ("critical", "Website Security"),
                     ("medium", "Website Security"), ("low", "Website Security"), ("high", "Website Privacy")}
    assert [(r.source, r.location, r.pii_type) for r in found.filter("pii_type <> 'OTHER'").collect()] == [("http://a.com/1", "T", "EMAIL")]
    assert found.filter("location like 'ftp%' or source like 'ftp%'").count() == 0
    assert {r.scan_id for r in found.collect()} == {"a.com"}
    capped = flows.scan_pages(pages, P.host(F.col("url")), pages_per_site=1)
    assert capped.filter("location = 'https://a.com/2'").count() == 0


def test_page_issues_take_one_pass(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = plan_of(P.page_issue_findings(P.analyze_pages(pages), F.col("page_id")))
    tree = plan.split("\n\n")[0]  # the details below it print the entity table, which has "Union;" in it
    assert tree.count("Scan parquet") == 1 and "Union" not in tree and "Exchange" not in tree


def test_tables(spark):
    users = spark.createDataFrame([(1, "a@b.com")], "id int, contact string")
    found = flows.scan_tables({"users": users, "audit_log": users}, "sqlite:///x.db", {"users": "id", "audit_log": "id"})
    assert {(r.location, r.pii_type) for r in found.collect()} == {
        ("users.contact", "EMAIL"), ("audit_log.contact", "EMAIL"), ("database_schema", "OTHER")}


def test_no_file_vanishes_and_none_is_read_twice(spark, tmp_path):
    base = folder(tmp_path)
    for name, text in (("_b.txt", "b@example.com"), (".c.txt", "c@example.com"), ("_sub/e.txt", "e@example.com"), ("big.txt", "x" * 5000),
                       ("x/a.txt", "Write to ann@example.com or call 555-123-4567."), ("crlf.txt", "one\r\nz@example.com\rtwo")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        scan = flows.scan_folder(spark, base, scan_id="f")
        errors = {r.path.split(base, 1)[1].lstrip("/"): r.error for r in scan.errors.collect()}
        rows = scan.findings.collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert {"b@example.com", "c@example.com", "e@example.com"} <= {r.content for r in rows}
    assert errors == {"big.txt": "File too large", "c.pdf": "No reader for .pdf"}
    assert len({r.finding_id for r in rows}) == len(rows)
    assert [r.context for r in rows if r.source == "crlf.txt"] == ["one z@example.com two"]

    def read_all(session, path):
        return session.createDataFrame([("own", "own", "own@example.com", None, {})], "source string, section_id string, text string, page_number int, meta map<string,string>")

    registry = Registry()
    registry.register(Reader("own", read_all, "document", [".txt"]))
    found = flows.scan_folder(spark, base, registry=registry).findings
    assert {r.source for r in found.collect()} == {"own", "m.eml"}


def test_scratch_keeps_no_values_and_goes(spark, sf):
    """What a scan with a diff report writes holds no detected value, and nothing is left after ``release``."""
    import pathlib

    from velum import session
    from velum.plans import QUERIES
    from velum.plans.corpus import document_findings

    session.release(spark)
    values = {r.content for r in document_findings(spark, sf).select("content").collect()}
    for name in ("gdpr_violations", "findings_summary", "diff_report", "signature_sets", "scan_events"):
        QUERIES[name](spark, sf).count()
    made = [pathlib.Path(p.removeprefix("file:")) for p in session._MADE]
    assert made and values
    for path in made:
        rows = spark.read.parquet(str(path)).collect()
        assert not values & {v for r in rows for v in r if isinstance(v, str)}
    session.release(spark)
    assert not any(p.exists() for p in made)


def test_stripped_text_like_the_standard_library(spark):
    from velum.functions.text import strip_tags

    texts = ["<p>&nbsp;Hi&nbsp;</p>", "&#10;x&#10;", "a  b c", " <b>x</b>\x1c ", "", "&amp;nbsp;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    assert [r.s for r in df.select(strip_tags(F.col("t")).alias("s")).collect()] == ["Hi", "x", "a b c", "x", "", "&nbsp;"]


def test_identifiers_do_not_end_in_a_line_feed(spark):
    from velum.functions.validators import VALIDATORS

    df = spark.createDataFrame([("0101011234",), ("0101011234\n",)], "t string")
    assert [r.v for r in df.select(VALIDATORS["danish_id"](F.col("t")).alias("v")).collect()] == [True, False]


def test_null_keys_are_equal_in_a_comparison(spark):
    from velum.operators import diff as X

    row = "scan_id string, location string, pii_type string, content string, severity string, confidence double, seq int"
    a = spark.createDataFrame([("s", None, "EMAIL", "v", "low", 0.5, 1)], row)
    kinds = [r.change_type for r in X.compare(a, a, order=F.col("seq")).collect()]
    assert kinds == ["unchanged"] and X.compare(a, a.limit(0), order=F.col("seq")).first().change_type == "resolved"


def test_a_tree_of_odd_names_and_unreadable_files(spark, tmp_path, monkeypatch):
    from velum.sources import tree

    monkeypatch.setattr(tree, "LEVELS", 6)  # a link that leads back ends there

    (tmp_path / "a/_b/.c/d e").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    for name in ("x.txt", "a/_b/.c/d e/ü%20#.TXT", "a/no ending", "a/empty.text"):
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"mail me@example.com")
    (tmp_path / "a/loop").symlink_to(tmp_path / "a")
    listed = tree.listing(spark, f"file:{tmp_path}")
    names = {r.path.removeprefix(f"file:{tmp_path}/") for r in listed.filter("error is null").collect()}
    assert {r.error for r in listed.filter("error is not null").collect()} == {"Folders are nested too deeply"}
    assert {"x.txt", "a/_b/.c/d e/ü%20#.TXT", "a/no ending", "a/empty.text"} <= names
    assert {r.path for r in tree.listing(spark, str(tmp_path), recursive=False).collect()} == {f"file:{tmp_path}/x.txt"}
    read = {r.path.rsplit("/", 1)[1]: r for r in tree.contents(tree.supported(listed.filter("path not like '%loop%'")), 1000).collect()}
    assert bytes(read["ü%20#.TXT"].content) == b"mail me@example.com" and read["empty.text"].content == b""
    vanished = listed.filter("path like '%x.txt'").withColumn("path", F.concat("path", F.lit(".gone.txt")))
    assert tree.contents(vanished, 1000).first().error.startswith("File cannot be read")
    small = tree.contents(tree.supported(listed.filter("path like '%x.txt'")), 3).first()
    assert (small.error, small.content) == ("File too large", None)
    assert not tree.reachable(f"{tmp_path}/none") and not tree.reachable("nostore://x/y")


def test_contacts_are_written_as_files_by_several_tasks(spark, sf):
    """A small table comes in one split, and a file costs far more than its row: one task would write them all."""
    from velum.plans import surfaces
    from velum.plans.corpus import contacts
    from velum.sources import tree

    assert contacts(spark, sf).rdd.getNumPartitions() == 1
    context = spark.sparkContext
    context.setJobGroup("written", "files of contacts")
    try:
        path = surfaces._written_contacts(spark, sf)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("written") for s in tracker.getJobInfo(j).stageIds}
    assert max(tracker.getStageInfo(s).numTasks for s in stages) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1

    body = F.concat_ws("\n", "full_name", "email_address", "phone", "ssn", "remark")
    want = {r.k: r.t for r in contacts(spark, sf).select(F.col("contact_id").cast("string").alias("k"), body.alias("t")).collect()}
    files = tree.contents(tree.listing(spark, path), 1 << 20).collect()
    got = {r.path.rsplit("/", 1)[1].lstrip(".")[1:].split(".")[0]: bytes(r.content).decode() for r in files}
    assert len(files) == len(want) and got == want
