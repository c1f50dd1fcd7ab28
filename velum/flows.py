"""Whole scans: a folder, a set of pages, a text column, a database. Each gives findings to work on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.patterns import DOCUMENT, Pattern
from velum.functions.text import FILE_KINDS, SUPPORTED_EXTENSIONS, extension
from velum.operators import pages as P
from velum.operators.detect import detect, explode_detections, with_detections
from velum.operators.findings import merge, to_findings
from velum.operators.tables import scan_database
from velum.plugins import Registry
from velum.session import spread
from velum.sources import files as FS
from velum.sources import tree as TREE


@dataclass
class Scan:
    """Findings, and the inputs that could not be read."""

    findings: DataFrame
    errors: DataFrame | None = None


def scan_sections(
    sections: DataFrame, scan_id: Column, *, patterns: Sequence[Pattern] = DOCUMENT, registry: Registry | None = None
) -> DataFrame:
    """Findings of ``sections`` rows, with the detectors of ``registry`` after the patterns."""
    keep = ["source", "section_id", "page_number"]
    if registry is None or not registry.detectors():
        hits = detect(sections, "text", keep, patterns)
    else:
        texts = spread(sections.select(*keep, "text"), *keep)
        found = with_detections(texts, "text", patterns)
        both = F.concat("detections", registry.detections(F.col("text")))
        hits = explode_detections(found.withColumn("detections", both), keep, "text")
    return to_findings(
        hits, scan_id=scan_id, source=F.col("source"), page_number=F.col("page_number"), section=F.col("section_id"))


def scan_folder(
    spark: SparkSession, folder: str, *, recursive: bool = True, scan_id: str | None = None,
    patterns: Sequence[Pattern] = DOCUMENT, registry: Registry | None = None,
) -> Scan:
    """Text and mail files of a folder, plus whatever the readers of ``registry`` can take.

    A registered reader takes the place of the built-in one for its endings. Names that start with ``_`` or ``.`` are read
    like any other. ``errors`` lists mails that could not be parsed, supported files without a reader here, and
    files and folders that could not be read. (In a store that only Spark's readers can open, hidden names are among the errors.)
    """
    readers = registry.of_kind("reader") if registry else []
    taken = {e.lower() for r in readers for e in r.extensions}
    of = {kind: tuple(e for e in FILE_KINDS[kind] if e not in taken) for kind in ("text", "eml")}
    read = [*taken, *of["text"], *of["eml"]]
    if TREE.reachable(folder):
        every, most = TREE.listing(spark, folder, recursive=recursive), FS.max_length(spark)
        texts, mails = (TREE.contents(every.filter(extension(F.col("path")).isin(*of[k])), most) if of[k] else None for k in ("text", "eml"))
        known = sorted({*SUPPORTED_EXTENSIONS, *read})
        unread = TREE.contents(TREE.supported(every, tuple(known)), most, probe=True)
        none = F.when(~extension(F.col("path")).isin(*read), F.concat(F.lit("No reader for "), extension(F.col("path"))))
        errors = [unread.select("path", F.coalesce("error", none).alias("error")).filter(F.col("error").isNotNull())]
    else:
        texts, mails = (FS.collect_files(spark, folder, recursive=recursive, extensions=of[k]) if of[k] else None for k in ("text", "eml"))
        errors = [FS.unread_files(spark, folder, read, recursive=recursive), FS.hidden_files(spark, folder, recursive=recursive)]
    # Every mail is decoded once for its text and once for its error, and read by no other reader.
    sections = [FS.read_text_files(texts)] if texts is not None else []
    sections += [FS.read_mail_files(mails)] if mails is not None else []
    sections += [reader.read(spark, folder) for reader in readers]
    errors += [FS.failed_mails(mails)] if mails is not None else []
    findings = scan_sections(reduce(DataFrame.unionByName, sections), F.lit(scan_id or folder), patterns=patterns, registry=registry)
    return Scan(findings, reduce(DataFrame.unionByName, errors))


def scan_pages(
    pages: DataFrame, scan_id: Column, *, key: str = "page_id", patterns: Sequence[Pattern] = DOCUMENT,
    pages_per_site: int | None = None,
) -> DataFrame:
    """Personal data on web pages, and the issues of their cookies, forms, headers and links."""
    valid = P.web_pages(pages)
    if pages_per_site is not None:
        valid = P.first_pages_per_site(valid, pages_per_site, key=key).drop("site")
    issues = P.page_issue_findings(P.analyze_pages(spread(valid, key)), scan_id)
    return merge(P.page_pii_findings(valid, scan_id, key=key, patterns=patterns), issues)


def scan_tables(
    tables: Mapping[str, DataFrame], source: str, keys: Mapping[str, str], *, rows: int | None = None
) -> DataFrame:
    """Column names, contents and schema of a database; with ``rows``, contents of a sample."""
    return scan_database(tables, source, keys, rows=rows)
