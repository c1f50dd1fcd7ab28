"""String helpers: whole-text redaction, tag stripping, entity decoding, reply parsing."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.functions.patterns import REDACTION_STEPS
from velum.functions.spans import let

# Connection schemes and file endings that can be scanned.
DATABASE_SCHEMES = ("postgresql", "mysql", "sqlite", "mssql")
FILE_KINDS = {
    "pdf": (".pdf",),
    "docx": (".docx", ".doc"),
    "text": (".txt", ".text"),
    "image": (".png", ".jpg", ".jpeg", ".tiff", ".bmp"),
    "excel": (".xlsx", ".xls"),
    "eml": (".eml",),
    "msg": (".msg",),
}
SUPPORTED_EXTENSIONS = tuple(e for endings in FILE_KINDS.values() for e in endings)


def redact_text(text: Column) -> Column:
    """Replace every e-mail, phone, SSN, card, IP and IBAN by ``[REDACTED_TYPE]``, in that order."""
    for name, regex in REDACTION_STEPS:
        text = F.regexp_replace(text, f"(?i){regex}", f"[REDACTED_{name}]")
    return text


_ENTITY = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
# Looked up first; all other names come from the standard HTML 5 table.
_COMMON = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"))
# Frequent names, written with their semicolon; a text with no others is decoded by plain replacements.
_USUAL = ("lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "middot", "bull", "hellip", "ndash", "mdash", "laquo", "raquo", "euro")
_UNUSUAL = rf"&(?!(?:{'|'.join(_USUAL)}|#39|amp);)(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z])"
# Old names that also count without a semicolon and in front of other letters, longest first.
_OLD_NAMES = sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)


# Marks around the names and characters of a lookup text.
_NAME, _CHAR = "\u0001", "\u0002"


def _look_up(table: dict[str, str], name: Column) -> Column:
    """Value of a name in a constant table, null if absent.

    The table is one string: a map literal of this size slows the optimizer down, which
    compares and hashes it in every rule.
    """
    text = F.lit("".join(f"{_NAME}{k}{_CHAR}{v}" for k, v in table.items()) + _NAME)
    after = F.split_part(text, F.concat(F.lit(_NAME), name, F.lit(_CHAR)), F.lit(2))
    return F.nullif(F.split_part(after, F.lit(_NAME), F.lit(1)), F.lit(""))


def _character(number: Column) -> Column:
    """The character of a numeric reference, with the corrections browsers apply."""
    windows = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    low = number.bitwiseAND(F.lit(0xFFFF).cast("long"))
    nothing = (
        number.between(0x1, 0x8) | number.between(0xE, 0x1F) | (number == 0xB) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
    )
    corrected = F.when(number.between(0x80, 0x9F), _look_up(windows, number.cast("string")))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
        .when(nothing, "")
        .otherwise(F.coalesce(corrected, plain))
    )


def _number(hit: Column) -> tuple[Column, Column]:
    """Decimal and hexadecimal reading: the code point of a numeric reference; longer ones than nine digits are out of range anyway."""
    digits = F.regexp_extract(hit, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    bounded = F.when(F.length(digits) > 9, F.lit("999999999")).when(digits == "", F.lit("0")).otherwise(digits)
    return F.conv(bounded, 10, 10).cast("long"), F.conv(bounded, 16, 10).cast("long")


def _entity(part: Column) -> Column:
    hit, name, old = part["hit"], F.substr(part["hit"], F.lit(2)), part["old"]
    out = None
    for entity, char in _COMMON:
        out = F.when(hit == entity, char) if out is None else out.when(hit == entity, char)
    rest = F.substr(hit, F.length(old) + 2)
    return out.when(hit.startswith("&#"), _character(part["number"])).otherwise(
        F.coalesce(_look_up(html5, name), F.when(old != "", F.concat(_look_up(html5, old), rest)), hit)
    )


def unescape(text: Column) -> Column:
    """Decode HTML entities inside the JVM, each once; texts without ``&`` are passed through.

    Of the usual entities only ``&amp;`` brings a new ``&``, so it is replaced last and nothing is decoded twice.
    """
    return let(text, lambda t: F.when(~t.contains("&"), t).when(~t.rlike(_UNUSUAL), _usual(t)).otherwise(_any_entity(t)))


def _usual(text: Column) -> Column:
    for name, char in (*((f"&{n};", html5[f"{n};"]) for n in _USUAL), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _any_entity(text: Column) -> Column:
    """What a piece is made of is bound by a first ``transform`` and used by a second one,
    which keeps the expression small although its parts are used several times.
    """
    pieces = F.arrays_zip(
        F.split(text, _ENTITY, -1).alias("gap"), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)).alias("hit")
    )

    common = [entity for entity, _ in _COMMON]

    def bind(p: Column) -> Column:
        decimal, hexadecimal = _number(p["hit"])
        return F.struct(
            p["gap"].alias("gap"),
            p["hit"].alias("hit"),
            F.when(p["hit"].rlike("^&#[xX]"), hexadecimal).when(p["hit"].startswith("&#"), decimal).alias("number"),
            F.when(p["hit"].isin(common) | p["hit"].startswith("&#"), "")
            .otherwise(F.regexp_extract(p["hit"], f"^&({'|'.join(_OLD_NAMES)})", 1)).alias("old"),
        )

    def decode(p: Column) -> Column:
        return F.when(p["hit"].isNull(), p["gap"]).otherwise(F.concat(p["gap"], _entity(p)))

    return F.array_join(F.transform(F.transform(pieces, bind), decode), "")


# White space of any script, and the separators that count as such in text files.
_SPACE = r"[\s\x1c-\x1f]+"


def strip_tags(markup: Column) -> Column:
    """Tags to spaces, white space of any kind collapsed, entities decoded, ends trimmed of what that brought."""
    flat = F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), f"(?U){_SPACE}", " ")
    return F.regexp_replace(unescape(flat), rf"(?U)\A{_SPACE}|{_SPACE}\z", "")


def fixed(value: Column, digits: int = 2) -> Column:
    """A number with fixed decimals, rounded from its exact binary value as C and Python do.

    (``format_string`` rounds the shortest decimal form, which turns 1188.945 into 1188.95.)
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_kind(path: Column) -> Column:
    """Parser label of a file; null means unsupported."""
    ext, out = extension(path), None
    for kind, endings in FILE_KINDS.items():
        out = F.when(ext.isin(*endings), kind) if out is None else out.when(ext.isin(*endings), kind)
    return out


def is_database_url(source: Column) -> Column:
    """True for ``scheme[+driver]:…`` with a known scheme."""
    scheme = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.split_part(scheme, F.lit("+"), F.lit(1)).isin(*DATABASE_SCHEMES)


def is_web_url(source: Column) -> Column:
    return F.lower(source).rlike("^https?://[^/?#]+")


def fenced_json(reply: Column) -> Column:
    """The JSON part of a model reply: a ```json block, else any ``` block, else all of it."""
    tagged = F.regexp_extract(reply, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(reply, r"(?s)```(.*?)(?:```|\z)", 1)
    return F.trim(F.when(reply.contains("```json"), tagged).when(reply.contains("```"), plain).otherwise(reply))


def parse_reply(reply: Column, schema: str) -> Column:
    """Struct from a model reply; null fields where it is not valid JSON."""
    return F.from_json(fenced_json(reply), schema, {"mode": "PERMISSIVE"})
