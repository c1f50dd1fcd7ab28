"""One token array per page: a single scan that respects quotes, comments and raw-text elements.

``tokens`` cuts a page into pieces that follow each other without gaps: comments and declarations, scripts, styles and noscript blocks
with their contents, tags, and the text between. Everything else about a page is read from that array: readable
text, title, links, forms. A ``>`` within a quoted attribute does not end a tag, a tag within a comment, a script
or a quoted attribute is none, and a ``<`` that opens no tag is text. What is not closed reaches to the end of the
page: comments, scripts, links, forms; an unfinished tag is text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.functions.spans import let, running

#: Inside a tag: anything but its end, quoted values as a whole. The bound keeps the regex engine's stack small; a tag
#: with more attributes ends at its first ``>``.
_INSIDE = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=){0,800}+"""
_RAW = "script|style|noscript"
TOKEN = (
    r"(?is)[^<]++"
    r"|<(?:!--.*?(?:-->|\z)|[!?][^>]*+>"
    rf"|({_RAW})(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
    rf"|/?[a-z]{_INSIDE}>|/?[a-z][^>]*+>)?+"
)
_HIDDEN = rf"(?i)^<(?:[!?]|(?:{_RAW})[\s/>])"
_ATTRIBUTE = r"""[^\s"'<>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def tokens(html: Column) -> Column:
    """The pieces of a page in order; joined they are the page again."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    return ~token.startswith("<") | (token == "<")


def is_tag(token: Column, *names: str, close: bool = False) -> Column:
    """Whether a token opens (or closes) one of the elements."""
    return token.rlike(rf"(?i)^<{'/' if close else ''}(?:{'|'.join(names)})[\s/>]")


def tag_name(token: Column) -> Column:
    """Lower-case name of a tag, with ``/`` in front where it closes; empty for other tokens."""
    return F.lower(F.regexp_extract(token, r"^<(/?[A-Za-z][^\s/>]*)", 1))


def with_offsets(found: Column) -> Column:
    """``array<struct<token, name, start, end>>``: tokens with their places in the page, in characters."""

    def placed(all_: Column) -> Column:
        ends = running(F.transform(all_, F.length), lambda a, b: a + b)
        return F.zip_with(all_, ends, lambda t, e: F.struct(t.alias("token"), tag_name(t).alias("name"), (e - F.length(t)).alias("start"), e.alias("end")))

    return let(found, placed)


def attribute_list(tag: Column) -> Column:
    """``name = value`` of a tag as written, in order. What stands in quotes is never taken for an attribute."""
    return F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))


def attribute(found: Column, name: str) -> Column:
    """The first value of an attribute, without quotes and as written; null where it is missing."""
    first = F.get(F.filter(found, lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    return F.regexp_replace(first, r"""^[^=]*+=\s*+["']?|["']$""", "")


def lined(found: Column) -> Column:
    """Text with a line break in place of every tag; what is hidden leaves nothing."""
    return F.array_join(F.transform(found, lambda t: F.when(is_text(t), t).when(t.rlike(_HIDDEN), "").otherwise("\n")), "")


def plain(found: Column) -> Column:
    """Text without any markup."""
    return F.array_join(F.filter(found, is_text), "")


def places(found: Column, test) -> Column:
    """Numbers of the tokens for which ``test`` holds."""
    numbered = F.transform(found, lambda t, i: F.when(test(t), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def between(found: Column, first: Column, last: Column) -> Column:
    """Tokens behind number ``first`` and before number ``last``."""
    return F.slice(found, first + 2, last - first - 1)


def title(found: Column) -> Column:
    """What stands in the first title element, as written; empty if there is none that is closed."""

    def of(rest: Column) -> Column:
        closing = F.get(places(rest, lambda t: is_tag(t, "title", close=True)), F.lit(0))
        return let(closing, lambda n: F.when(n.isNotNull(), F.array_join(F.slice(rest, F.lit(1), n), "")).otherwise(""))

    start = F.get(places(found, lambda t: is_tag(t, "title")), F.lit(0))
    return let(start, lambda s: F.when(s.isNotNull(), let(F.slice(found, s + 2, F.size(found)), of)).otherwise(""))


def links(found: Column) -> Column:
    """``array<struct<tag, text>>`` of the link tags; a link ends at its end tag or at the next link."""

    def of(edges: Column) -> Column:
        opening = F.filter(edges, lambda e: e["open"])
        return F.transform(opening, lambda e: F.struct(F.get(found, e["at"]).alias("tag"), plain(between(found, e["at"], e["next"])).alias("text")))

    at = places(found, lambda t: is_tag(t, "/?a"))
    edges = let(at, lambda p: F.transform(p, lambda i, n: F.struct(
        i.alias("at"), F.coalesce(F.get(p, n + 1), F.size(found)).alias("next"), is_tag(F.get(found, i), "a").alias("open"))))
    return let(edges, of)


def forms(found: Column) -> Column:
    """``array<struct<tag, fields>>`` of the forms: each with the tags of its fields. A form within a form is part of it."""

    def of(edges: Column) -> Column:
        # A tag of the same kind as the one before it opens or closes nothing.
        real = F.filter(edges, lambda e, n: (n == 0) | (F.get(edges, n - 1)["open"] != e["open"]))

        def read(all_: Column) -> Column:
            spans = F.transform(all_, lambda e, n: F.struct(
                e["open"].alias("open"), F.get(found, e["at"]).alias("tag"),
                between(found, e["at"], F.coalesce(F.get(all_, n + 1)["at"], F.size(found))).alias("inner")))
            return F.transform(F.filter(spans, lambda s: s["open"]), lambda s: F.struct(
                s["tag"].alias("tag"), F.filter(s["inner"], lambda t: is_tag(t, "input", "textarea", "select")).alias("fields")))

        return let(real, read)

    at = places(found, lambda t: is_tag(t, "/?form"))
    return let(F.transform(at, lambda i: F.struct(i.alias("at"), is_tag(F.get(found, i), "form").alias("open"))), of)
