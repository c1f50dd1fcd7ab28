"""URL verdicts against a plain version of rules and ranks."""

import re

import pytest

from velum.llm import hosts
from velum.llm.queries import QUERIES, RULES

COLUMNS = "page_id long, url string, html string, host string, rank double"


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain(pages):
    judged = []
    for i, url, _ in pages:
        host, path = split(url)
        fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((i, host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))))
    links = {}
    for (_, host, *_), (_, _, html) in zip(judged, pages):
        for link in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)""", html or ""):
            to = split("x:" + link if link.startswith("//") else link)[0]
            if host and to and host != to:
                links[host, to] = links.get((host, to), 0) + 1

    def spread(edges, weights):
        total = sum(weights.values())
        start = {h: w / total for h, w in weights.items()} if total else {}
        ranks = dict(start)
        for _ in range(hosts.ROUNDS if edges and total else 0):
            out, flow = {}, {}
            for (a, _), n in edges.items():
                out[a] = out.get(a, 0) + n
            for (a, b), n in edges.items():
                flow[b] = flow.get(b, 0) + ranks.get(a, 0) * n / out[a]
            back = 1 - hosts.DAMPING * sum(flow.values())
            ranks = {h: hosts.DAMPING * flow.get(h, 0) + back * start.get(h, 0) for h in {*flow, *start}}
        return ranks

    def seeds(verdict):
        out = {}
        for _, host, _, _, v in judged:
            if host and v == verdict:
                out[host] = out.get(host, 0) + 1
        return out

    trust, distrust = spread(links, seeds("allow")), spread({(b, a): n for (a, b), n in links.items()}, seeds("block"))
    return sorted(((i, h, p, r, v or ("block" if round(distrust.get(h, 0), 12) > round(trust.get(h, 0), 12) else "allow")) for i, h, p, r, v in judged), key=str)


PAGES = [
    (1, "http://A.org/x", '<a href="http://b.net/1"><a HREF=\'http://b.net/2\'>'), (2, "http://b.net/q?x#y", "<a href=//c.net/2>"), (3, "http://c.net", ""),
    (4, "https://d.net/", '<a class=x href = "https://Bad.com/de/7"> <a href="https://c.net">'), (5, "https://bad.com/de/1", None), (6, None, None),
    (7, "nourl", "x"), (8, "http://e.net/en", '<a href="/local"><a href="http://e.net/">'), (9, "http://x.example.org/es/1", ""), (9, "http://x.example.org/es/1", ""),
    (None, "http://www.example.org/en/1?p", ""), (11, "http://notorg/fr/", ""), (12, "http://org?x", ""), (13, "://y.com/fr/a://b", '<a href="http://d.net">'),
    (14, "http://f.net/" + "p" * 50_000, "<a href='http://d.net/'>" * 5000),
]


def test_against_the_plain_version(spark):
    df = spark.createDataFrame([(*p, "x", 1.0) for p in PAGES], COLUMNS)
    got = hosts.verdicts(df, RULES)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == plain(PAGES)


def test_query_on_a_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op10_url_verdicts"](spark, sf).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == plain(pages)


def test_empty_table(spark):
    assert hosts.verdicts(spark.createDataFrame([], COLUMNS), RULES).collect() == []


def test_too_many_rules(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        hosts.rule_of(F.lit("a"), F.lit("b"), [("allow", f"h{i}", "/") for i in range(hosts.MAX_RULES + 1)])
