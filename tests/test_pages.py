import html as html_module
import random
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from velum.functions.text import unescape
from velum.operators import pages as P


def page(spark, html, url="https://example.com/a/b", **extra):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return df.withColumns(extra) if extra else df


def test_text(spark):
    html = ("<html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body>"
            "<p>First  paragraph</p><noscript>hidden</noscript><!-- <p>no</p> --><p> Second &amp; last&nbsp;</p></body></html>")
    row = page(spark, html).select(P.page_text(F.col("html")).alias("t")).first()
    assert row.t == "T\nFirst\nparagraph\nSecond & last"


def test_forms(spark):
    html = ('<form action="/submit" method="post"><input type="email" name="email"><input type="text" name="name">'
            "<input type='text' name='username'></form><form><input name=q><select name=x placeholder='Phone'></select></form>")
    rows = page(spark, html).select(F.inline(P.forms(F.col("html")))).collect()
    assert (rows[0].action, rows[0].method, len(rows[0].inputs), rows[0].collects_pii) == ("/submit", "POST", 3, True)
    assert [i.may_collect_pii for i in rows[0].inputs] == [True, True, True]
    assert (rows[1].action, rows[1].method) == ("", "GET") and [i.may_collect_pii for i in rows[1].inputs] == [False, True]
    assert rows[0].inputs[0].type == "email" and rows[1].inputs[0].type == "text"


def test_forms_in_noscript_vanish(spark):
    assert page(spark, "<noscript><form><input name=email></form></noscript>").select(F.size(P.forms(F.col("html"))).alias("n")).first().n == 0


@pytest.mark.parametrize("html, found", [
    ('<a href="/privacy">x</a>', True), ('<a href="/x">Privacy <b>Policy</b></a>', True),
    ('<a href="/x">Data Protection</a>', True), ('<a href="/about">About</a>', False), ("<a>privacy</a>", False), ("", False)])
def test_policy(spark, html, found):
    assert page(spark, html).select(P.has_privacy_policy(F.col("html")).alias("p")).first().p is found


@pytest.mark.parametrize("name, kind", [
    ("_ga", "analytics"), ("ad_tracker", "advertising"), ("_fbp", "advertising"), ("session_id", "functional"),
    ("PHPSESSID", "functional"), ("theme", "unknown"), ("gallery", "analytics")])
def test_cookie_classes(spark, name, kind):
    assert spark.range(1).select(P.cookie_class(F.lit(name)).alias("k")).first().k == kind


def cookies(*rows):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("boolean").alias("secure"), F.lit(True).alias("httponly"),
                              F.lit("Lax").alias("samesite")) for n, s in rows])


def test_cookie_findings(spark):
    df = P.analyze_pages(page(spark, "", cookies=cookies(("_ga", True), ("ad_tracker", False), ("theme", None))))
    rows = {(r.location, r.context, r.severity) for r in P.cookie_findings(df, F.col("url")).collect()}
    assert rows == {
        ("Cookie: _ga", "analytics cookie detected", "medium"), ("Cookie: ad_tracker", "advertising cookie detected", "high"),
        ("Cookie: ad_tracker", "Cookie missing Secure flag", "medium"), ("Cookie: theme", "Cookie missing Secure flag", "medium")}


@pytest.mark.parametrize("url, action, unsafe", [
    ("https://e.com", "", False), ("http://e.com", "", True), ("https://e.com", "/submit", True),
    ("https://e.com", "https://e.com/x", False), ("https://e.com", "http://e.com/x", True)])
def test_form_findings(spark, url, action, unsafe):
    df = P.analyze_pages(page(spark, f'<form action="{action}"><input name="email"></form>', url))
    rows = {(r.severity, r.context) for r in P.form_findings(df, F.col("url")).collect()}
    assert (("critical", f"Form collecting PII without HTTPS: {action}") in rows) is unsafe
    assert ("high", "Form collecting PII: 1 fields") in rows


def test_form_without_pii_gives_nothing(spark):
    assert P.form_findings(P.analyze_pages(page(spark, "<form><input name=q></form>", "http://e.com")), F.col("url")).count() == 0


def test_security(spark):
    headers = F.create_map(*[F.lit(x) for x in (
        "Strict-Transport-Security", "x", "content-security-policy", "x", "X-Frame-Options", "x", "X-Content-Type-Options", "x")])
    good = P.analyze_pages(page(spark, "", headers=headers))
    assert set(good.first().security.asDict().values()) == {True}
    assert P.security_findings(good, F.col("url")).count() == 0
    bad = P.analyze_pages(page(spark, "", "http://e.com"))
    assert {r.severity for r in P.security_findings(bad, F.col("url")).collect()} == {"critical", "medium", "low"}


def test_internal_links(spark):
    html = '<a href="/page1">1</a><a href="https://example.com/page2">2</a><a href="https://other.com/p">3</a><a name="x">4</a>'
    got = [r.link for r in P.internal_links(page(spark, html)).collect()]
    assert got == ["https://example.com/page1", "https://example.com/page2"]


def test_links_that_are_not_closed(spark):
    html = '<a href="/one">1 <a href="/two">2</a> text <abbr href="/no">x</abbr><a href="/three">end'
    got = [r.link.rsplit("/", 1)[1] for r in P.internal_links(page(spark, html)).collect()]
    assert got == ["one", "two", "three"]


LINKS = ["/x", "x", "../x", "./x", "../../../x", "?q=1", "#f", "", "//o.com/x", "https://o.com/x", "mailto:a@b.c", "x/../y", "a/b/", "..", "/a/./b", "/a/b/../c?d=/../e"]


@pytest.mark.parametrize("base", ["https://e.com/a/b/c?q=1#f", "https://e.com", "https://e.com/", "http://e.com:80/a/"])
def test_links_resolve_like_the_standard(spark, base):
    df = spark.createDataFrame([(base, h) for h in LINKS], "b string, h string")
    for r in df.select("h", P.resolve(F.col("b"), F.col("h")).alias("got")).collect():
        assert r.got == urljoin(base, r.h), r.h


def test_given_pages_against_a_parser(spark, sf):
    """Links of all given pages, found by Python's HTML parser and joined by ``urljoin``."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = []

    class Finder(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href") is not None:
                self.found.append(dict(attrs)["href"])

    for row in pages.collect():
        finder = Finder()
        finder.found = []
        finder.feed(row.html)
        for href in finder.found:
            link = urljoin(row.url, href)
            if urlparse(link).netloc == urlparse(row.url).netloc:
                want.append((row.page_id, link))
    got = [(r.page_id, r.link) for r in P.internal_links(pages).collect()]
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("url, ok", [("https://e.com", True), ("http://e.com/x", True), ("HTTP://e.com", True),
                                     ("ftp://e.com", False), ("https://", False), ("https:///x", False), ("e.com", False)])
def test_web_addresses(spark, url, ok):
    assert (P.web_pages(page(spark, "", url)).count() == 1) is ok


def test_page_cap(spark):
    rows = [(i, f"https://{'hot' if i % 3 else 'h' + str(i % 7)}.com/{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = P.first_pages_per_site(df, 5).collect()
    assert sorted(r.page_id for r in got if r.site == "hot.com") == [1, 2, 4, 5, 7]
    assert max(sum(1 for r in got if r.site == s) for s in {r.site for r in got}) == 5


def test_page_pii(spark):
    row = P.page_pii_findings(page(spark, "<title>Team</title><p>Write to a@b.com</p>"), F.col("url")).first()
    assert (row.source, row.location, row.pii_type, row.severity, row.source_type) == ("https://example.com/a/b", "Team", "EMAIL", "high", "web")


# --- tokens ---

TRICKY = [
    '<a title="x > y" href="/one">1</a>', "<a title='a>b' href=/two>2</a >", "<p>a < b and c > d</p>", '<a data-href="/no" href="/yes">x</a>',
    '<a title=" href=/no " HREF = "/yes">x</a>', "<!-- <a href='/no'> --><b>text</b>", "<!-- open <a href=x>", "<script>if (a < b) '<a href=x>'</script>after",
    "<style>a > b {}</style>", "<SCRIPT src='a>b'>x</SCRIPT\n>end", "<script>never closed <p>", "<div <p>nested</p>", "plain", "", "<", "a<", "</>x", "<3 hearts",
    "<textarea><b>x</b></textarea>", '<img alt="a"b>c', "<a href='it''s'>q</a>", "<a title=it's href=/x>it's</a>", "<!doctype html><?xml version='1'?><p/>",
    "<form action='/a>b'><input name='x>y'><form><input name=z></form><input name=out>", "<a\nhref\n=\n'/nl'\n>x</a>", "<scripty>s</scripty>",
    "<p title='never closed>x</p> text <b>y</b>", "x" * 5000 + "<b " + "a=1 " * 3000 + ">end</b>", "<a " + "x" * 100_000 + ">t</a>",
]


def test_tokens_are_the_page(spark):
    from velum.functions import markup

    df = spark.createDataFrame(list(enumerate(TRICKY)), "i int, html string")
    rows = df.select("html", markup.tokens(F.col("html")).alias("t"), markup.with_offsets(markup.tokens(F.col("html"))).alias("o")).collect()
    for r in rows:
        assert "".join(r.t) == r.html
        assert [r.html[o.start : o.end] for o in r.o] == r.t
    by = {r.html: r for r in rows}
    assert by[TRICKY[0]].t == ['<a title="x > y" href="/one">', "1", "</a>"] and [o.name for o in by[TRICKY[0]].o] == ["a", "", "/a"]
    assert by[TRICKY[2]].t == ["<p>", "a ", "<", " b and c > d", "</p>"]
    assert by[TRICKY[7]].t == [TRICKY[7][: TRICKY[7].index("after")], "after"]
    assert by[TRICKY[10]].t == [TRICKY[10]] and by[TRICKY[6]].t == [TRICKY[6]]


@pytest.mark.parametrize("html, text", [
    (TRICKY[0], "1"), (TRICKY[2], "a < b and c > d"), (TRICKY[5], "text"), (TRICKY[7], "after"), (TRICKY[9], "end"), (TRICKY[17], "<3 hearts"),
    (TRICKY[22], ""), ("a\u00a0 \n\t b  c\u2028d e \x1c", "a\nb\nc\nd e"), ("  a\tb  ", "a\tb"), (None, None)])
def test_text_of_tricky_pages(spark, html, text):
    assert page(spark, html).select(P.page_text(F.col("html")).alias("t")).first().t == text


def test_links_of_tricky_pages(spark):
    want = {0: ["/one"], 1: ["/two"], 3: ["/yes"], 4: ["/yes"], 5: [], 6: [], 7: [], 21: ["/x"], 24: ["/nl"]}
    df = spark.createDataFrame([(i, TRICKY[i]) for i in want], "i int, html string")
    for r in df.select("i", P.anchors(F.col("html")).alias("a")).collect():
        assert [a.href for a in r.a] == want[r.i], TRICKY[r.i]


def test_forms_of_tricky_pages(spark):
    rows = page(spark, TRICKY[23]).select(F.inline(P.forms(F.col("html")))).collect()
    assert [(r.action, [i.name for i in r.inputs]) for r in rows] == [("/a>b", ["x>y", "z"])]
    rows = page(spark, "</form><form><input name=a>").select(F.inline(P.forms(F.col("html")))).collect()
    assert [[i.name for i in r.inputs] for r in rows] == [["a"]]


@pytest.mark.parametrize("html, title", [("<title>A &amp; <b>B</title>x<title>C</title>", "A & <b>B"), ("<!-- <title>no</title> --><TITLE\n>yes</TITLE >", "yes"),
                                         ("<title>open", ""), ("", "")])
def test_titles(spark, html, title):
    assert page(spark, html).select(P.title(F.col("html")).alias("t")).first().t == title


def test_usual_entities_are_decoded_once_like_any_other(spark):
    """Texts with usual entities only take plain replacements, all others are cut into pieces; both give what a browser reads."""
    pick = random.Random(4)
    usual = ["&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;", "&copy;", "&mdash;", "lt;", "amp;", "#39;", "& ", "x", "quot;", ";"]
    other = [*usual, "&copy", "&#65;", "&#x41", "&Eacute;", "&nosuch;", "&amp", "&"]
    texts = ["".join(pick.choices(pieces, k=pick.randint(1, 8))) for pieces in (usual, other) for _ in range(400)] + ["", "&", "&amp;lt;", "&amp;amp;"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", unescape(F.col("t")).alias("u")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.u == (None if r.t is None else html_module.unescape(r.t)), r.t
