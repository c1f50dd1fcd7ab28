"""Exact top-k by inner product with Fagin's threshold algorithm.

Every task holds blocks of candidates with one sorted list per dimension. For a query, the lists are
read in step, from the end that the sign of the query's component favours; what comes up is scored in
full. The sum of what the next places could add at most bounds every candidate not seen yet, and the
search of a block stops when that bound cannot beat the query's kth result so far, which is
carried from block to block within a task.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
id. Ties go to the smaller id. A missing component of a shorter vector counts as zero. Among rows that
repeat a query's id one is the query (the least vector), and no row with the query's id is among its
candidates; other repeated rows are candidates each. Without queries or candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a block, list entries that are read at a step, and queries that are sent out at once.
BLOCK, STEP, QUERIES = 4_096, 48, 2_048


def integers(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component; null for a vector that takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when((F.size(vector) > 0) & ~odd, whole)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of int64, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    most = int(sizes.max()) if len(sizes) else 0
    width = max(most, width or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Lists:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.order = np.argsort(self.vectors, axis=0, kind="stable")  # places of a dimension by rising value
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def search(self, own: int, query: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores falling, ids) with what this block adds."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        up = query[used] > 0
        weights = query[used]
        seen = np.zeros(n, bool)
        scores, ids = best
        if not len(used):
            return _first(k, *_joined(best, np.zeros(n, np.int64), self.ids, own))
        for at in range(0, n, STEP):
            to = min(at + STEP, n)
            places = np.where(up, self.order[::-1][at:to, used], self.order[at:to, used]).ravel()
            new = np.zeros(n, bool)
            new[places] = True
            new &= ~seen
            fresh = np.flatnonzero(new)
            seen |= new
            if len(fresh):
                scores, ids = _first(k, *_joined((scores, ids), self.vectors[fresh] @ query, self.ids[fresh], own))
            if to < n:
                ahead = np.where(up, self.sorted[n - 1 - to, used], self.sorted[to, used])
                # A candidate that only equals the kth score can still win by its smaller id.
                if len(scores) == k and int(ahead @ weights) < scores[-1]:
                    break
        return scores, ids


def _joined(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    other = ids != own
    return np.concatenate([best[0], scores[other]]), np.concatenate([best[1], ids[other]])


def _first(k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= kth
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` best candidates of every query.

    Queries go out in blocks of ``QUERIES``, the only thing that is broadcast; each block is searched
    in all candidates where these are read, without a shuffle of vectors. Tasks pass on ``k`` rows a
    query, which are cut again before the last shuffle by query.
    """
    candidates = candidates.select(F.col(key).alias("__id"), integers(F.col(vector), scale).alias("__v"))
    candidates = candidates.filter(F.col("__id").isNotNull() & F.col("__v").isNotNull())
    queries = queries.select(F.col(key).alias("__id"), integers(F.col(vector), scale).alias("__v"))
    queries = queries.filter(F.col("__id").isNotNull() & F.col("__v").isNotNull()).groupBy("__id").agg(F.min("__v").alias("__v"))
    spark = candidates.sparkSession
    n = queries.count()
    found = []
    blocks = -(-n // QUERIES)
    for block in range(max(blocks, 1)):
        asked = queries.filter(F.pmod(F.xxhash64("__id"), F.lit(max(blocks, 1))) == block).toArrow() if n else None
        sent = spark.sparkContext.broadcast(
            (asked["__id"].to_numpy(), _matrix(asked["__v"])) if n and len(asked) else (np.empty(0, np.int64), np.empty((0, 0), np.int64)))
        found.append(candidates.mapInArrow(_searcher(sent, k), "query_id long, id long, score long"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        rows.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )


def _searcher(sent, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = sent.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own)
        for b in batches:
            if not len(own):
                continue
            ids = b.column("__id").to_numpy()
            for at in range(0, len(ids), BLOCK):
                block = _matrix(b.column("__v").slice(at, BLOCK), vectors.shape[1])
                asked = vectors
                if block.shape[1] > vectors.shape[1]:
                    asked = np.pad(vectors, ((0, 0), (0, block.shape[1] - vectors.shape[1])))
                # Whole numbers below 2**53 multiply exactly, and faster, as doubles.
                if float(np.abs(block).max(initial=0)) * float(np.abs(asked).max(initial=0)) * block.shape[1] < 2**53:
                    block, asked = block.astype(np.float64), asked.astype(np.float64)
                lists = Lists(ids[at : at + BLOCK], block)
                best = [lists.search(int(q), v, k, x) for q, v, x in zip(own, asked, best)]
        counts = [len(s) for s, _ in best]
        if sum(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, counts)), pa.array(np.concatenate([i for _, i in best]).astype(np.int64)),
                 pa.array(np.concatenate([s for s, _ in best]).astype(np.int64))], names=["query_id", "id", "score"])

    return search
