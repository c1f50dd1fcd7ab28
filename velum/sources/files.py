"""Folders of text and mail files as ``sections`` rows."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.text import SUPPORTED_EXTENSIONS, extension, file_kind, strip_tags

SECTIONS = "source string, section_id string, text string, page_number int, meta map<string,string>"


def _glob(extensions: tuple[str, ...]) -> str:
    """A name filter for the file listing that ignores case: ``*{.[tT][xX][tT],…}``."""
    def either(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*{" + ",".join(either(e) for e in extensions) + "}"


def collect_files(
    spark: SparkSession, folder: str, *, recursive: bool = True, extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS
) -> DataFrame:
    """Files with a supported ending: path, kind, size, time, content.

    The name filter applies while listing; contents are only read when a later step uses them.
    """
    files = _listed(spark, folder, recursive, extensions)
    # The size is checked on the listing, so a file that is too large is not opened.
    return files.filter(F.col("length") <= max_length(spark)).select(
        "path", file_kind(F.col("path")).alias("kind"), "length", "modificationTime", "content"
    )


def _listed(spark: SparkSession, folder: str, recursive: bool, extensions: Iterable[str]) -> DataFrame:
    extensions = tuple(extensions)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", _glob(extensions))
        .load(folder)
    )
    return files.filter(extension(F.col("path")).isin(*extensions))


def max_length(spark: SparkSession) -> int:
    """The largest file that can be one row."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))


def unread_files(spark: SparkSession, folder: str, read: Iterable[str], *, recursive: bool = True) -> DataFrame:
    """Supported files that no reader takes, and files that are too large, with the reason; no contents are read."""
    files = _listed(spark, folder, recursive, sorted({*SUPPORTED_EXTENSIONS, *read}))
    large = F.col("length") > max_length(spark)
    none = F.concat(F.lit("No reader for "), extension(F.col("path")))
    return files.filter(large | ~extension(F.col("path")).isin(*read)).select(
        "path", F.when(extension(F.col("path")).isin(*read), "File too large").otherwise(none).alias("error"))


def hidden_files(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """Supported files below names that start with ``_`` or ``.``, which Spark's readers pass over.

    They come from the file system's own listing, names only.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, top = system.listFiles(root, recursive), system.makeQualified(root).toUri().getPath().rstrip("/")
    rows = []
    while found.hasNext():
        path = found.next().getPath()
        below = path.toUri().getPath()[len(top) :]
        if any(part[:1] in ("_", ".") for part in below.split("/")) and below.lower().endswith(SUPPORTED_EXTENSIONS):
            rows.append((path.toString(), "Hidden from Spark's file readers"))
    return spark.createDataFrame(rows, "path string, error string")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def read_text_files(files: DataFrame) -> DataFrame:
    """Text files as UTF-8 where valid, else Latin-1; the encoding is recorded, and line ends become line feeds."""
    content = F.col("content")
    utf8 = F.call_function("is_valid_utf8", content.cast("string"))
    return files.filter((F.col("kind") == "text") & F.col("content").isNotNull()).select(
        base_name(F.col("path")).alias("source"),
        F.col("path").alias("section_id"),
        F.regexp_replace(F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")), "\r\n?", "\n").alias("text"),
        F.lit(None).cast("int").alias("page_number"),
        F.create_map(F.lit("encoding"), F.when(utf8, "utf-8").otherwise("latin-1")).alias("meta"),
    )


_HEADERS = ("From", "To", "Cc", "Subject", "Date")
_MAILS = (
    "path string, `from` string, `to` string, cc string, subject string, date string, attachments string, "
    "parts array<struct<kind: string, body: string>>, error string"
)


def _decode_mail(content: bytes) -> tuple:
    """Headers, attachment names and text parts of one mail; only MIME decoding happens here."""
    msg = email.message_from_bytes(content, policy=email.policy.default)
    several = msg.is_multipart()
    names, parts = [], []
    for part in msg.walk() if several else [msg]:
        if several and part.get_content_disposition() == "attachment" and part.get_filename():
            names.append(part.get_filename())
        kind = part.get_content_type()
        attached = "attachment" in str(part.get("Content-Disposition", ""))
        if several and (attached or kind not in ("text/plain", "text/html")):
            continue
        try:
            body = part.get_content()
        except (LookupError, ValueError, KeyError):
            continue
        if isinstance(body, str):
            parts.append({"kind": "html" if several and kind == "text/html" else "plain", "body": body})
    return (*(str(msg.get(h, "")) for h in _HEADERS), ", ".join(names), parts, None)


def _decode_mails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "from", "to", "cc", "subject", "date", "attachments", "parts", "error"]
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"]):
            try:
                rows.append((path, *_decode_mail(bytes(content))))
            except Exception as e:
                rows.append((path, "", "", "", "", "", "", [], str(e)))
        yield pd.DataFrame(rows, columns=columns)


def parse_mails(files: DataFrame) -> DataFrame:
    """One row per mail file: headers, text parts, and the error of a file that cannot be parsed."""
    return files.filter((F.col("kind") == "eml") & F.col("content").isNotNull()).select("path", "content").mapInPandas(_decode_mails, _MAILS)


def read_mail_files(files: DataFrame) -> DataFrame:
    """Mail files as one section each: header lines, then plain and tag-stripped html parts.

    Python only decodes MIME; tags and entities are dealt with by expressions, and a mail
    stays one row throughout, so nothing is shuffled.
    """
    mails = parse_mails(files).filter(F.col("error").isNull())
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("From: "), F.col("from")),
        F.concat(F.lit("To: "), F.col("to")),
        F.when(F.col("cc") != "", F.concat(F.lit("Cc: "), F.col("cc"))),
        F.concat(F.lit("Subject: "), F.col("subject")),
        F.lit(""),
    )
    bodies = F.transform("parts", lambda p: F.when(p["kind"] == "html", strip_tags(p["body"])).otherwise(p["body"]))
    fields = ("from", "to", "cc", "subject", "date", "attachments")
    return mails.select(
        base_name(F.col("path")).alias("source"),
        F.col("path").alias("section_id"),
        F.concat_ws("\n", head, bodies).alias("text"),
        F.lit(None).cast("int").alias("page_number"),
        F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c))], F.lit("type"), F.lit("eml")).alias("meta"),
    )


def failed_mails(files: DataFrame) -> DataFrame:
    """Mail files that could not be parsed, with the reason."""
    return parse_mails(files).filter(F.col("error").isNotNull()).select("path", "error")


def unsupported(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that no reader takes, with the reason: the ``errors`` output of a folder scan."""
    return paths.filter(file_kind(F.col(path)).isNull()).select(
        path, F.concat(F.lit("Unsupported file type: "), extension(F.col(path))).alias("error")
    )


def read_folder(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """Text and mail files of a folder as sections."""
    files = collect_files(spark, folder, recursive=recursive)
    return read_text_files(files).unionByName(read_mail_files(files))
