"""Stored web pages: readable text, links, forms, cookies, security, and the findings they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions import markup
from velum.functions.patterns import DOCUMENT, Pattern
from velum.functions.spans import let
from velum.functions.text import is_web_url, unescape
from velum.operators.detect import detect
from velum.operators.findings import REDACTED, conform, finding_id, to_findings
from velum.operators.summary import top_per_group
from velum.session import spread

# Word lists and classes of the page analysis.
COOKIE_CLASSES = (
    ("analytics", ("analytics", "ga", "_ga", "_gid")),
    ("advertising", ("ad", "doubleclick", "fbp")),
    ("functional", ("session", "sess", "auth")),
)
FORM_WORDS = ("email", "phone", "name", "address", "ssn", "dob", "birth", "credit", "card", "passport")
POLICY_WORDS = ("privacy", "policy", "data protection")
SECURITY_HEADERS = {
    "strict_transport_security": "strict-transport-security",
    "content_security_policy": "content-security-policy",
    "x_frame_options": "x-frame-options",
    "x_content_type_options": "x-content-type-options",
}
DEFAULT_PAGE_CAP = 50
#: Column with the tokens of a page, made once for all that is read from them.
TOKENS = "__tokens"

# Line breaks and double spaces part the text; white space beside them goes.
_SPACES = r"\s\u00A0\x1C-\x1E\u0085\u2028\u2029"
_BREAK = rf"(?:(?! {{2}})[ \t\u00A0])*+(?: {{2}}|[\n\x0B\f\r\x1C-\x1E\u0085\u2028\u2029])[{_SPACES}]*+"
_EDGE = r"^[\s\u00A0]++|[\s\u00A0]++$"


def _found(html: Column) -> Column:
    """The token array of a page. Functions with a parameter ``found`` take it instead of the page."""
    return markup.tokens(html)


def page_text(html: Column, found: Column | None = None) -> Column:
    """Readable text: one chunk per line, split at tags and double spaces, blanks dropped."""
    lines = unescape(markup.lined(_found(html) if found is None else found))
    return F.regexp_replace(F.regexp_replace(lines, _BREAK, "\n"), _EDGE, "")


def attributes(tag: Column, *names: str) -> Column:
    """Values of attributes of a tag as an array, null where missing; double, single or no quotes."""
    values = let(markup.attribute_list(tag), lambda found: F.array(*[markup.attribute(found, n) for n in names]))
    return F.transform(values, unescape)


def title(html: Column, found: Column | None = None) -> Column:
    return unescape(markup.title(_found(html) if found is None else found))


def link_count(html: Column, found: Column | None = None) -> Column:
    return F.size(F.filter(_found(html) if found is None else found, lambda t: markup.is_tag(t, "a")))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link. Query-only, fragment-only and dotted paths follow the usual rules."""
    link = F.trim(href)
    origin = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.\-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    query = F.regexp_extract(base, r"^([^#]*)", 1)
    path = F.regexp_replace(page, r"(?i)^[a-z][a-z0-9+.\-]*://[^/]*", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = F.concat(origin, _without_dots(F.concat(folder, link)))
    return (
        F.when(link == "", base)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(link)))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(query, link))
        .otherwise(joined)
    )


def _without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved; untouched where there are none."""
    main, rest = F.regexp_extract(path, r"^([^?#]*)", 1), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    segments = F.split(main, "/", -1)

    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(s == ".", acc)
            .when((s == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1))
            .when(s == "..", acc)
            .otherwise(F.array_append(acc, s))
        )

    clean = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    slash = F.when(main.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(main.rlike(r"(^|/)\.\.?(/|$)"), F.concat(clean, slash, rest)).otherwise(path)


def anchors(html: Column, found: Column | None = None) -> Column:
    """``array<struct(href, text)>`` of the links that have an address."""
    links = let(_found(html) if found is None else found, markup.links)
    pairs = F.transform(links, lambda a: F.struct(F.get(attributes(a["tag"], "href"), F.lit(0)).alias("href"), unescape(a["text"]).alias("text")))
    return F.filter(pairs, lambda p: p["href"].isNotNull())


def internal_links(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html", url: str = "url") -> DataFrame:
    """One row per link that stays on the page's own host."""
    rows = pages.select(*keep, F.col(url).alias("__url"), F.explode_outer(anchors(F.col(html))).alias("a"))
    resolved = rows.filter(F.col("a").isNotNull()).select(
        *keep, F.col("__url"), resolve(F.col("__url"), F.col("a.href")).alias("link")
    )
    return resolved.filter(host(F.col("link")) == host(F.col("__url"))).drop("__url")


def has_privacy_policy(html: Column, found: Column | None = None) -> Column:
    """Whether the text or address of some link speaks of a privacy policy."""
    wanted = "|".join(POLICY_WORDS)
    return F.exists(anchors(html, found), lambda a: F.lower(F.concat_ws("\n", a["href"], a["text"])).rlike(wanted))


def _mentions(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def forms(html: Column, found: Column | None = None) -> Column:
    """``array<struct(action, method, inputs, collects_pii)>`` of a page."""

    def field(found: Column) -> Column:
        name = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
        hint = F.coalesce(F.get(found, F.lit(2)), F.lit(""))
        return F.struct(
            name.alias("name"),
            F.coalesce(F.get(found, F.lit(1)), F.lit("text")).alias("type"),
            hint.alias("placeholder"),
            (_mentions(name, FORM_WORDS) | _mentions(hint, FORM_WORDS)).alias("may_collect_pii"),
        )

    def read(form: Column) -> Column:
        return F.struct(
            attributes(form["tag"], "action", "method").alias("head"),
            F.transform(F.transform(form["fields"], lambda t: attributes(t, "name", "type", "placeholder")), field).alias("inputs"),
        )

    def shape(found: Column) -> Column:
        return F.struct(
            F.coalesce(F.get(found["head"], F.lit(0)), F.lit("")).alias("action"),
            F.upper(F.coalesce(F.get(found["head"], F.lit(1)), F.lit("get"))).alias("method"),
            found["inputs"].alias("inputs"),
            F.exists(found["inputs"], lambda i: i["may_collect_pii"]).alias("collects_pii"),
        )

    return F.transform(F.transform(let(_found(html) if found is None else found, markup.forms), read), shape)


def cookie_class(name: Column) -> Column:
    """Class by fragments of the name, in fixed order. Short fragments also hit unrelated names."""
    low, out = F.lower(name), None
    for label, words in COOKIE_CLASSES:
        test = low.rlike("|".join(words))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("unknown")


def security(url: Column, headers: Column | None = None) -> Column:
    """``struct(uses_https, <one flag per header>)``; header names are compared in lower case."""
    names = None if headers is None else F.transform(F.map_keys(headers), lambda k: F.lower(k))
    flags = [
        (F.lit(False) if names is None else F.coalesce(F.array_contains(names, header), F.lit(False))).alias(field)
        for field, header in SECURITY_HEADERS.items()
    ]
    return F.struct(url.startswith("https://").alias("uses_https"), *flags)


def analyze_pages(pages: DataFrame, *, html: str = "html", url: str = "url") -> DataFrame:
    """Everything known about a page as nested columns next to its own columns."""
    cols = pages.columns
    headers = F.col("headers") if "headers" in cols else None
    cookies = F.col("cookies") if "cookies" in cols else F.array().cast(
        "array<struct<name:string,secure:boolean,httponly:boolean,samesite:string>>")
    page, found = F.col(html), F.col(TOKENS)
    tokenised = pages.withColumn(TOKENS, markup.tokens(page))
    return tokenised.select(
        *[F.col(f"`{c}`") for c in cols],
        page_text(page, found).alias("text"),
        title(page, found).alias("title"),
        link_count(page, found).alias("links_count"),
        has_privacy_policy(page, found).alias("has_privacy_policy"),
        forms(page, found).alias("forms"),
        F.transform(cookies, lambda c: c.withField("type", cookie_class(c["name"]))).alias("cookie_types"),
        security(F.col(url), headers).alias("security"),
    )


def _issue(source: str, location: Column, context: Column | str, confidence: float, severity: Column | str,
           articles: Sequence[str], advice: str) -> Column:
    def lit(v):
        return F.lit(v) if isinstance(v, str) else v

    return F.struct(
        F.lit(source).alias("source"),
        location.alias("location"),
        lit(context).alias("context"),
        F.lit(confidence).alias("confidence"),
        lit(severity).alias("severity"),
        F.array(*[F.lit(a) for a in articles]).alias("gdpr_articles"),
        F.lit(advice).alias("recommendation"),
    )


def cookie_issues(cookie: Column) -> Column:
    """Issues of one classified cookie: tracking, and a missing Secure flag."""
    kind, place = cookie["type"], F.concat(F.lit("Cookie: "), cookie["name"])
    tracking = _issue(
        "Website Cookies", place, F.concat(kind, F.lit(" cookie detected")), 0.9,
        F.when(kind == "advertising", "high").otherwise("medium"), ["Art. 5", "Art. 6", "Art. 7"],
        "Ask for consent before setting cookies of this kind.",
    )
    insecure = _issue(
        "Website Cookies", place, "Cookie missing Secure flag", 1.0, "medium", ["Art. 32"],
        "Set the Secure flag, so that the cookie only travels encrypted.",
    )
    secure = F.coalesce(cookie["secure"], F.lit(False))
    return F.array(F.when(kind.isin("analytics", "advertising"), tracking), F.when(~secure, insecure))


def form_issues(form: Column, url: Column) -> Column:
    """Issues of one form that collects personal data.

    An empty action posts to the page itself; any other action must be an https address.
    """
    action, asks = form["action"], form["collects_pii"]
    safe = F.when(action == "", url.startswith("https://")).otherwise(action.startswith("https://"))
    fields = F.size(F.filter(form["inputs"], lambda i: i["may_collect_pii"]))
    unsafe = _issue(
        "Website Form", url, F.concat(F.lit("Form collecting PII without HTTPS: "), action), 1.0,
        "critical", ["Art. 32"], "Send personal data over https only.",
    )
    collecting = _issue(
        "Website Form", url, F.concat(F.lit("Form collecting PII: "), fields.cast("string"), F.lit(" fields")), 0.8, "high",
        ["Art. 5", "Art. 6", "Art. 13"], "Say at the form why the data is needed and ask for as little as possible.",
    )
    return F.array(F.when(asks & ~safe, unsafe), F.when(asks & (fields > 0), collecting))


def security_issues(facts: Column, url: Column) -> Column:
    """Missing https, HSTS and content policy."""
    checks = [
        ("uses_https", "Website not using HTTPS", "critical", "Serve the site over https and redirect to it."),
        ("strict_transport_security", "Missing Strict-Transport-Security header", "medium",
         "Send the HSTS header with a max-age of a year."),
        ("content_security_policy", "Missing Content-Security-Policy header", "low",
         "Send a content security policy."),
    ]
    return F.array(*[
        F.when(~facts[field], _issue("Website Security", url, text, 1.0, sev, ["Art. 32"], advice))
        for field, text, sev, advice in checks
    ])


def policy_issues(has_policy: Column, url: Column) -> Column:
    issue = _issue(
        "Website Privacy", url, "No privacy policy link found", 0.7, "high", ["Art. 12", "Art. 13"],
        "Link a privacy policy from every page.",
    )
    return F.array(F.when(~has_policy, issue))


def _issue_findings(pages: DataFrame, issues: Column, scan_id: Column) -> DataFrame:
    present = F.filter(issues, lambda i: i.isNotNull())
    # Outer generators throughout: the inner ones make the optimizer evaluate the arrays twice.
    flat = pages.select(scan_id.cast("string").alias("scan_id"), F.inline_outer(present))
    flat = flat.filter(F.col("location").isNotNull())
    return conform(
        flat.withColumns(
            {
                "source_type": F.lit("web"),
                "pii_type": F.lit("OTHER"),
                "content": F.lit(REDACTED),
                "finding_id": finding_id(F.col("scan_id"), F.col("location"), F.col("source"), F.col("context")),
            }
        )
    )


def cookie_findings(pages: DataFrame, scan_id: Column) -> DataFrame:
    """Findings of the ``cookie_types`` arrays of analysed pages."""
    return _issue_findings(pages, F.flatten(F.transform("cookie_types", cookie_issues)), scan_id)


def form_findings(pages: DataFrame, scan_id: Column, url: str = "url") -> DataFrame:
    """Findings of the ``forms`` arrays of analysed pages."""
    return _issue_findings(pages, F.flatten(F.transform("forms", lambda f: form_issues(f, F.col(url)))), scan_id)


def security_findings(pages: DataFrame, scan_id: Column, url: str = "url") -> DataFrame:
    """Findings of the ``security`` facts of analysed pages."""
    return _issue_findings(pages, security_issues(F.col("security"), F.col(url)), scan_id)


def policy_findings(pages: DataFrame, scan_id: Column, url: str = "url") -> DataFrame:
    """Findings of pages without a link to a privacy policy."""
    return _issue_findings(pages, policy_issues(F.col("has_privacy_policy"), F.col(url)), scan_id)


def page_issue_findings(pages: DataFrame, scan_id: Column, url: str = "url") -> DataFrame:
    """Cookie, form, security and policy findings of analysed pages in a single pass."""
    issues = F.concat(
        F.flatten(F.transform("cookie_types", cookie_issues)),
        F.flatten(F.transform("forms", lambda f: form_issues(f, F.col(url)))),
        security_issues(F.col("security"), F.col(url)),
        policy_issues(F.col("has_privacy_policy"), F.col(url)),
    )
    return _issue_findings(pages, issues, scan_id)


def page_pii_findings(
    pages: DataFrame, scan_id: Column, *, key: str = "page_id", html: str = "html", url: str = "url",
    patterns: Sequence[Pattern] = DOCUMENT,
) -> DataFrame:
    """Personal data in the readable text of the pages, graded for the web."""
    # Spread before the markup is parsed, which costs more than the search.
    source = spread(
        pages.select(F.col(key).alias("__key"), scan_id.cast("string").alias("__scan"), F.col(url).alias("__url"),
                     F.col(html).alias("__html")),
        "__key",
    )
    tokenised = source.withColumn(TOKENS, markup.tokens(F.col("__html")))
    texts = tokenised.select(
        "__key", "__scan", "__url", title(F.col("__html"), F.col(TOKENS)).alias("__title"),
        page_text(F.col("__html"), F.col(TOKENS)).alias("text")
    )
    hits = detect(texts, "text", ["__key", "__scan", "__url", "__title"], patterns, spread_input=False)
    return to_findings(hits, scan_id=F.col("__scan"), source=F.col("__url"), location=F.col("__title"), source_type="web")


def web_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose address is http or https with a host."""
    return pages.filter(is_web_url(F.col(url)))


def first_pages_per_site(pages: DataFrame, n: int, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """At most ``n`` pages of each site, lowest ``key`` first."""
    return top_per_group(pages.withColumn("site", host(F.col(url))), ["site"], [F.col(key)], n)
