"""Folders listed and read in tasks, names that start with ``_`` or ``.`` included.

Spark's file readers pass over such names. Here a folder tree is listed level by level: each level is a table of folders, whose tasks
list them and give the files and the folders of the next level. The driver sees neither names nor contents; it counts
the folders of a level to know when to stop. Listings are written to the shared scratch folder, so a lost executor
costs a part of a level. Contents are read where a later step asks for them, a few megabytes a batch.

Folders are opened by their address: local paths and the stores that Arrow's file systems know (``s3``, ``gs``, ``hdfs``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.text import SUPPORTED_EXTENSIONS, extension, file_kind
from velum.session import materialize

ENTRIES = "path string, folder boolean, length long, modificationTime timestamp, error string"
CONTENTS = "path string, kind string, length long, modificationTime timestamp, content binary, error string"
#: Bytes of contents in a batch, and levels of folders; a link that leads back into its own tree ends there.
BATCH_BYTES, LEVELS = 16 << 20, 64


def opened(address: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what stands before paths in an address."""
    if "://" not in address or address.startswith("file:"):
        path = "/" + address.removeprefix("file:").lstrip("/") if address.startswith("file:") else os.path.abspath(address)
        return fs.LocalFileSystem(), path, "file:"
    system, path = fs.FileSystem.from_uri(address)
    return system, path, address.split("://", 1)[0] + "://"


def reachable(address: str) -> bool:
    """Whether Arrow can open the folder; other stores are left to Spark's readers."""
    try:
        system, path, _ = opened(address)
        return system.get_file_info(path).type == fs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowKeyError, OSError, NotImplementedError):
        return False


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)


_TIME = pa.timestamp("us", "UTC")
_ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modificationTime", _TIME), ("error", pa.string())])
_CONTENT = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modificationTime", _TIME),
                      ("content", pa.binary()), ("error", pa.string())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for address in batch.column("path").to_pylist():
            try:
                system, path, prefix = opened(address)
                infos = system.get_file_info(fs.FileSelector(path))
            except OSError as e:
                yield _batch([(address, False, None, None, f"Folder cannot be listed: {e.strerror or e}")], _ENTRY)
                continue
            for at in range(0, len(infos), 10_000):
                rows = [(prefix + i.path, i.type == fs.FileType.Directory, i.size, i.mtime, None) for i in infos[at : at + 10_000]]
                yield _batch(rows, _ENTRY)


def listing(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """``(path, length, modificationTime, error)`` of every file, hidden or not, and of every folder that cannot be listed."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(folder,)], "path string")
    out = None
    for depth in range(LEVELS):
        found = materialize(level.repartition(tasks, "path").mapInArrow(_entries, ENTRIES), "listing")
        files = found.filter(~F.col("folder")).drop("folder")
        out = files if out is None else out.unionByName(files)
        level = found.filter("folder").select("path")
        if not recursive or level.isEmpty():
            return out
    deep = level.select("path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"),
                        F.lit("Folders are nested too deeply").alias("error"))
    return out.unionByName(deep)


def supported(files: DataFrame, extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS) -> DataFrame:
    return files.filter(F.col("error").isNotNull() | extension(F.col("path")).isin(*extensions))


def contents(files: DataFrame, max_length: int, *, probe: bool = False) -> DataFrame:
    """Files with ``kind`` and ``content``, or with ``error`` where they cannot be read or are larger than ``max_length``.

    ``probe`` opens files without reading them: the errors alone, at little cost.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, kind, length, time, error in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if error is None and length > max_length:
                    error = "File too large"
                elif error is None:
                    try:
                        system, place, _ = opened(path)
                        with system.open_input_stream(place) as f:
                            content = f.read(1 if probe else length)
                    except OSError as e:
                        error = f"File cannot be read: {e.strerror or e}"
                rows.append((path, kind, length, time, content, error))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield _batch(rows, _CONTENT)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _CONTENT)

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = files.select("path", file_kind(F.col("path")).alias("kind"), "length", "modificationTime", "error")
    return named.repartition(tasks, "path").mapInArrow(read, CONTENTS)
