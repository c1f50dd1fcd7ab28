"""Benchmark decontamination: an Aho-Corasick automaton over the windows of all benchmark items.

Texts are lower-cased (A-Z) and read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``words``
consecutive words of an item; an item of fewer words is one window, an item without words has none.
Every text is scanned once; matches are mapped back to word numbers and to offsets in the original text.

One automaton holds up to ``MAX_WINDOWS`` windows. The windows of a larger benchmark are dealt by hash into parts of that
size: each part's automaton scans the numbered texts in a pass of its own and leaves only the rows with hits, and the runs of
all passes are united per text. Neither the driver nor a worker ever holds more than one part.

Null and empty texts have no words and no hits, and null or empty items no windows. Repeated documents
get repeated rows, repeated items share their windows; item ids are compared as strings and a null id
is the empty string. An empty benchmark leaves every document clean. Columns of ``docs`` other than the
text stay as they are, whatever their names; the added column replaces one of the same name.
"""

from __future__ import annotations

import uuid
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.spans import let, running
from velum.llm.tokens import ALNUM, each_text, texts, unused
from velum.session import materialize, scratch_dir

#: Windows in one automaton.
MAX_WINDOWS = 200_000

#: A word, as ``_words`` takes them, for counting in SQL.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<first:int,last:int,start:int,end:int>>"


def _words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def windows_of(benchmark: DataFrame, item_id: str, text: str, words: int) -> DataFrame:
    """``(item, window)``: windows as words joined by blanks, once an item."""

    @F.arrow_udf("array<string>")
    def windows(column: pa.Array) -> pa.Array:
        out = []
        for raw in texts(column):
            w = _words(raw)
            out.append(list(dict.fromkeys(b" ".join(w[i : i + words]).decode() for i in range(max(1, len(w) - words + 1)))) if w else [])
        return pa.array(out, pa.list_(pa.string()))

    return benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.explode(windows(F.col(text))).alias("window")).distinct()


def _collected(windows: DataFrame) -> dict[str, list[str]]:
    """A part of bounded size, by window."""
    return {r["window"]: sorted(r["items"]) for r in windows.groupBy("window").agg(F.collect_set("item").alias("items")).collect()}


class Scanner:
    """The automaton. Bytes are read as Latin-1, so offsets in bytes and characters of the key agree."""

    def __init__(self, windows: dict[str, list[str]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in windows.items():
            self.automaton.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, items))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, int, list[str], list[tuple[int, int, int, int]]]:
        """Number of words, of hit words, ids of items found, and runs of hit words: first and last
        word, and start and end (exclusive) in bytes of the original text."""
        words = _words(text)
        if not words or not len(self.automaton):
            return len(words), 0, [], []
        joined = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(joined.decode("latin-1")))
        if not found:
            return len(words), 0, [], []
        # In ``joined`` every blank ends a word or opens the text: the n-th blank (from 0) stands before word n.
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        last = np.searchsorted(blanks, np.array([end for end, _ in found])) - 1
        first = last - np.array([size for _, (size, _) in found]) + 1
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, last + 1, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)])))
        runs = [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]
        # The translated text keeps every byte in its place.
        plain = np.concatenate([[0], np.frombuffer(text.translate(ALNUM), np.uint8) != 32, [0]]).astype(np.int8)
        bounds = np.flatnonzero(np.diff(plain)).reshape(-1, 2)
        spans = [(a, b, int(bounds[a, 0]), int(bounds[b, 1])) for a, b in runs]
        items = sorted({i for _, (_, ids) in found for i in ids})
        return len(words), sum(b - a + 1 for a, b in runs), items, spans


#: The automaton that this worker made last, with the broadcast it was made from.
_MADE: dict[str, Scanner] = {}


def _scanner(name: str, windows: Broadcast) -> Scanner:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Scanner(windows.value)
    return _MADE[name]


def scanned(spark: SparkSession, windows: dict[str, list[str]], text: Column | str) -> Column:
    """What a text shares with the windows of one automaton: ``struct<n_words, n_hit, item_ids, spans>``."""
    sent, name = spark.sparkContext.broadcast(windows), uuid.uuid4().hex

    @F.arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        scanner = _scanner(name, sent)
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(
            pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))])
        rows = []
        for raw in each_text(column):
            n, hit, items, spans = scanner.scan(raw)
            rows.append({"n_words": n, "n_hit": hit, "item_ids": items, "spans": [dict(zip(("first", "last", "start", "end"), s)) for s in spans]})
        return pa.array(rows, kind)

    return scan(text)


def _united(runs: Column) -> Column:
    """Runs of hit words, which may overlap or touch, as the runs of all of them together."""
    # A run that no earlier one reaches opens a new one, which ends with the farthest of those before the next opening.
    def of(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda r: r["last"]), lambda a, b: F.greatest(a, b))
        far = running(F.transform(ordered, lambda r: r["end"]), lambda a, b: F.greatest(a, b))

        def joined(ends: Column, bytes_: Column) -> Column:
            opens = F.filter(F.transform(ordered, lambda _, i: i), lambda i: (i == 0) | (F.get(ordered, i)["first"] > F.get(ends, i - 1) + 1))

            def shown(at: Column) -> Column:
                last = lambda n: F.coalesce(F.get(at, n + 1), F.size(ordered)) - 1
                return F.transform(at, lambda i, n: F.struct(
                    F.get(ordered, i)["first"].alias("first"), F.get(ends, last(n)).alias("last"),
                    F.get(ordered, i)["start"].alias("start"), F.get(bytes_, last(n)).alias("end")))

            return let(opens, shown)

        return let(reach, lambda ends: let(far, lambda bytes_: joined(ends, bytes_)))

    return let(F.array_sort(runs), of)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, out: str = "found", item_id: str = "item_id",
                  item_text: str = "text", words: int = 10) -> DataFrame:
    """``docs`` with what each text shares with the benchmark, as ``struct<n_words, n_hit, item_ids, spans>``.

    ``item_ids`` is sorted; ``spans`` are runs of hit words, first and last word number, and the start
    and end (exclusive) in bytes of the text's UTF-8.
    """
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    windows = materialize(windows_of(benchmark, item_id, item_text, words), "windows")
    parts = ceil(windows.select("window").distinct().count() / MAX_WINDOWS)
    if parts <= 1:
        return docs.select(*kept, scanned(spark, _collected(windows), text).alias(out))
    mark = unused("text_number", docs)
    rows = materialize(docs.withColumn(mark, F.monotonically_increasing_id()), "texts")
    path = scratch_dir(spark, "hits")
    for part in range(parts):
        some = _collected(windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part))
        found = rows.select(mark, scanned(spark, some, text).alias("found")).filter(F.col("found.n_hit") > 0)
        found.select(mark, "found.item_ids", "found.spans").write.mode("append").parquet(path)
    # A text has at most one row a part.
    hits = spark.read.parquet(path).groupBy(mark).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__items"), F.flatten(F.collect_list("spans")).alias("__spans"))
    hits = hits.select(mark, "__items", _united(F.col("__spans")).alias("__spans"))
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    none = F.array().cast("array<string>")
    result = F.struct(
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("__items", none).alias("item_ids"),
        F.coalesce("__spans", F.array().cast("array<struct<first:int,last:int,start:int,end:int>>")).alias("spans"))
    return rows.join(hits, mark, "left").select(*kept, result.alias(out))
