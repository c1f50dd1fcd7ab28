"""Ranked lexical search: posting lists cut into geometric blocks with exact summaries.

The documents are searched for a whole set of queries at once, with integer scores: an item's term weighs
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``, a document's term ``(10**9 * tf) div (1000 * tf + 8 * m)`` with
``m = 10 + (90 * n * N) div L``.

Queries are taken in blocks of about ``BLOCK_TERMS`` terms. For a block, one pass over the texts writes every document as
a vector over the block's terms; document counts, frequencies and lengths are aggregates of that table. The vectors
are then indexed and searched where they lie, in shards of as many documents as ``CELLS`` allows:

* Documents get sketches (a random projection of the weighted vector). Each posting list is cut into blocks by the
  nearest of several documents of the list, so a block holds similar documents.
* A block's summary is the greatest value that any of its documents has for each term, over the terms that a query with
  the block's own term can ask for.
* The summary, weighed with a query, bounds every document of the block. Blocks are scored from the highest bound on;
  a block is skipped only when its bound is below the k-th best score that the task knows by then. At equal bounds it
  is scored, as a smaller id may win the tie.

A task passes on its k best documents a query, and these are cut to k a query in slices. Every document with a
score above 0 is in the list of a term it shares with the query, so nothing is lost.

Null and empty texts have no terms, are not counted, are never found, and items without terms have no rows. Repeated documents
are documents of their own; a null id comes behind all others of the same score. Each row of ``queries`` is ranked by itself,
also where a key stands twice. Texts of any length are read whole. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.tokens import ALNUM, texts
from velum.operators.summary import top_per_group
from velum.session import materialize, scratch_dir

#: Terms of a block of queries, with repeats (a query with more is a block of its own, at most).
BLOCK_TERMS = 16_384
#: Documents times terms of a shard: one table of 4-byte numbers.
CELLS = 6_000_000
#: Documents of a block of a posting list, on average, and numbers of a sketch.
BLOCK, SKETCH = 32, 24
#: Bytes of text that are counted together.
GROUP = 4 << 20

_VECTORS = "doc long, n long, terms binary, counts binary"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM).split()


def query_terms(text: Column | str) -> Column:
    """The different terms of a query."""

    @F.arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([[w.decode() for w in dict.fromkeys(terms_of(t))] for t in texts(column)], pa.list_(pa.string()))

    return found(text)


def _numbers(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive parts of 4-byte numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype("<i4").tobytes()),
                                                                  pa.py_buffer(parts.astype("<i4").tobytes())])


def vectors(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """``(doc, n, terms, counts)`` of every document with a term: its length, and the given terms that it holds."""
    given = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): i for i, t in enumerate(given.value)}
        size = max(1, len(number))

        def rows(keys: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids, doc = np.concatenate(found), np.repeat(np.arange(len(found)), n)
            pairs, counts = np.unique(doc[ids >= 0] * size + ids[ids >= 0], return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(len(found) + 1) * size)
            batch = pa.RecordBatch.from_arrays([keys, pa.array(n), _numbers(pairs % size, bounds), _numbers(counts, bounds)],
                                               names=["doc", "n", "terms", "counts"])
            return batch.filter(pa.array(n > 0))

        for batch in batches:
            found, start, held = [], 0, 0
            for i, raw in enumerate(texts(batch.column(1))):
                words = terms_of(raw)
                found.append(np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)))
                held += len(raw)
                if held >= GROUP:
                    yield rows(batch.column(0).slice(start, len(found)), found)
                    found, start, held = [], i + 1, 0
            if found:
                yield rows(batch.column(0).slice(start, len(found)), found)

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(counted, _VECTORS)


def frequencies(made: DataFrame) -> DataFrame:
    """``(term, df)`` of the vectors' terms, counted in the tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"))
            if len(more) > len(sums):
                sums, more = more.astype(np.int64), sums
            sums[: len(more)] += more
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["term", "df"])

    return made.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Queries:
    """A block of queries over numbered terms, with the weights of the terms."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        self.items, self.weights = items, weights
        self.own = [weights[t] for t in items]
        self.asking: list[list[int]] = [[] for _ in weights]
        for q, found in enumerate(items):
            for t in found.tolist():
                self.asking[t].append(q)
        # Of the terms that queries with this term hold: their numbers, and the weight of each for each such query.
        self.columns: list[np.ndarray] = []
        for asking in self.asking:
            self.columns.append(np.unique(np.concatenate([items[q] for q in asking])) if asking else np.empty(0, np.int64))

    def weighing(self, term: int) -> np.ndarray:
        columns, asking = self.columns[term], self.asking[term]
        out = np.zeros((len(columns), len(asking)))
        for place, q in enumerate(asking):
            out[np.searchsorted(columns, self.items[q]), place] = self.own[q]
        return out


class Best:
    """The k best documents of each query so far: highest score, then no null id, then smallest id."""

    def __init__(self, queries: int, k: int):
        empty = np.empty(0, np.int64)
        self.k, self.score, self.doc, self.none = k, [empty] * queries, [empty] * queries, [empty.astype(bool)] * queries
        self.least = np.zeros(queries)  # scores below this are of no use

    def add(self, q: int, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        good = score > 0
        score, doc, none = (np.concatenate([a[q], b[good]]) for a, b in ((self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score[q], self.doc[q], self.none[q] = score[order], doc[order], none[order]
        if len(order) == self.k:
            self.least[q] = score[order[-1]]


def blocks_of(members: np.ndarray, sketches: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in blocks: its members, those of a block together, and where each block starts."""
    if len(members) <= size:
        return members, np.zeros(1, np.int64)
    centres = members[:: size]
    near = np.argmax(sketches[members] @ sketches[centres].T, axis=1)
    order = np.argsort(near, kind="stable")
    near = near[order]
    return members[order], np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))


def search_shard(values: np.ndarray, doc: np.ndarray, none: np.ndarray, queries: Queries, best: Best, projection: np.ndarray) -> int:
    """Index a shard, documents by terms, and score it for all queries; returns the number of documents scored."""
    sketches = (values * queries.weights.astype(np.float32)) @ projection
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)
    held, lists = np.nonzero(values.T)
    edges = np.searchsorted(held, np.arange(len(queries.weights) + 1))
    blocks: list[np.ndarray] = []
    query, bound, block = [], [], []
    for term in np.flatnonzero(np.diff(edges)).tolist():
        asking = queries.asking[term]
        members, starts = blocks_of(lists[edges[term] : edges[term + 1]], sketches)
        summary = np.maximum.reduceat(values[np.ix_(members, queries.columns[term])], starts, axis=0)
        bounds = summary.astype(np.float64) @ queries.weighing(term)  # whole numbers below 2**53
        b, q = np.nonzero((bounds >= best.least[asking]) & (bounds > 0))
        query.append(np.asarray(asking)[q])
        bound.append(bounds[b, q])
        block.append(b + len(blocks))
        blocks += np.split(members, starts[1:])
    if not query:
        return 0
    query, bound, block = map(np.concatenate, (query, bound, block))
    order = np.lexsort((-bound, query))
    query, bound, block = query[order], bound[order], block[order]
    edges = np.searchsorted(query, np.arange(len(queries.items) + 1))
    scored = 0
    for q in np.flatnonzero(np.diff(edges)).tolist():
        at, end, step = edges[q], edges[q + 1], 2
        seen = np.zeros(len(values), bool)
        while at < end and bound[at] >= best.least[q]:
            to = min(end, at + step)
            new = np.unique(np.concatenate([blocks[b] for b in block[at:to][bound[at:to] >= best.least[q]].tolist()]))
            new = new[~seen[new]]
            seen[new] = True
            scored += len(new)
            best.add(q, values[np.ix_(new, queries.items[q])].astype(np.int64) @ queries.own[q], doc[new], none[new])
            at, step = to, step * 2
    return scored


def _found(made: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """``(__q, doc, score)``: the k best of each task for each query."""
    sent = made.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = sent.value
        queries, best = Queries([t for _, t in asked], w), Best(len(asked), k)
        projection = np.random.default_rng(7).standard_normal((len(w), SKETCH)).astype(np.float32)
        most = max(16, CELLS // max(1, len(w)))
        for batch in batches:
            for start in range(0, len(batch), most):
                part = batch.slice(start, most)
                ids = part.column("doc")
                held = part.column("terms").to_pylist()
                term = np.frombuffer(b"".join(held), "<i4")
                tf = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<i4").astype(np.int64)
                row = np.repeat(np.arange(len(part)), [len(h) // 4 for h in held])
                m = 10 + 90 * part.column("n").to_numpy() * documents // words
                values = np.zeros((len(part), len(w)), np.int32)
                values[row, term] = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
                search_shard(values, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), queries, best, projection)
        for (q, _), score, doc, none in zip(asked, best.score, best.doc, best.none):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), pa.array(doc, mask=none), pa.array(score)],
                                                 names=["__q", "doc", "score"])

    return made.mapInArrow(run, "__q long, doc long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "doc_id", text: str = "text", query_key: str = "item_id",
           query_text: str = "text") -> DataFrame:
    """``(query_key, rank, key, score)``: the ``k`` best documents of every query with a score above 0."""
    spark = docs.sparkSession
    asked = queries.select(F.monotonically_increasing_id().alias("__q"), F.col(query_key).alias("__item"), query_terms(query_text).alias("terms"))
    asked = materialize(asked.filter(F.size("terms") > 0), "queries")
    # Blocks of queries go through the driver one at a time, so its memory does not grow with their number.
    parts = ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS)
    path = scratch_dir(spark, "found")
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("__q"), F.lit(parts)) == part).select("__q", "terms").orderBy("__q").collect()
        terms = sorted({t for r in rows for t in r.terms})
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        items = [(r["__q"], np.array(sorted(number[t] for t in r.terms), np.int64)) for r in rows]
        made = materialize(vectors(docs, key, text, terms), "vectors")
        documents, words = made.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        df = {r["term"]: r["df"] for r in frequencies(made).collect()}  # of this block's terms
        weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        _found(made, items, weights, documents, words, k).write.mode("append").parquet(path)
    kind = "__q long, doc long, score long"
    written = parts and documents
    found = spark.read.schema(kind).parquet(path) if written else spark.createDataFrame([], kind)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    best = top_per_group(found, ["__q"], order, k).withColumn("rank", F.row_number().over(Window.partitionBy("__q").orderBy(*order)))
    return best.join(asked, "__q").select(F.col("__item").alias(query_key), "rank", F.col("doc").alias(key), "score")
