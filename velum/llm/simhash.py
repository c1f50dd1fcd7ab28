"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Different fingerprints are dealt into groups, groups into tiles, and the fingerprints of two tiles are
compared all with all by exclusive-or and bit counts in numpy. Tile pairs whose population counts
differ by more than the radius are skipped, and so are those whose texts differ too much in length,
if a ratio is asked for. With a small radius, groups are made by the pigeonhole principle: of
``radius + 2`` blocks of bits at least two are equal in any linked pair, so only fingerprints that
agree in two blocks meet. With a larger radius all are one group.

Of the links in a pair of tiles a spanning forest is passed on, so many near copies give few rows and
yet the same components. Copies share a fingerprint and are compared once.

Null texts and texts without words have fingerprint zero and are linked like any other; a text of any
length is read whole; repeated rows are in the same component. Null ids stay and are never the
smallest id, unless no other is there. An empty table gives an empty result. Further columns are not read
by ``near_duplicates`` and stay as they are in ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.components import components
from velum.llm.tokens import each_text, unused
from velum.session import materialize

#: Fingerprints in a tile, and rows of a tile that are compared with another tile at once.
TILE, STRIPE = 8_192, 64
#: Up to this radius groups are made by pairs of blocks; beyond it they would not be small.
BLOCKED_RADIUS = 6
#: Groups up to this size are compared by shifting the sorted rows against themselves.
TINY = 8
_LANES = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _lane(h: np.ndarray, constant: int) -> np.ndarray:
    """Another hash from a hash, for further 64 bits of a fingerprint."""
    if not constant:
        return h
    h = (h ^ np.uint64(constant)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles, repeats included."""
    found = raw.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, n)


def bits_of(h: np.ndarray, lanes: int = 1) -> bytes:
    """The fingerprint: a bit is 1 if it is set in over half the hashes. ``lanes`` times 64 bits, high bits first."""
    if not len(h):
        return bytes(8 * lanes)
    out = []
    for constant in _LANES[:lanes]:
        planes = np.unpackbits(_lane(h, constant).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(planes.sum(axis=0, dtype=np.int64) * 2 > len(h)).tobytes())
    return b"".join(out)


def fingerprint(text: Column | str, words: int = 4, lanes: int = 1, repeats: bool = True) -> Column:
    """``struct<bits binary, shingles long>`` of a text, from all shingles or, without ``repeats``, from the different ones."""

    @F.arrow_udf("bits binary, shingles long")
    def made(column: pa.Array) -> pa.Array:
        bits, counts = [], []
        for t in each_text(column):
            h = hashes(t, words) if repeats else np.unique(hashes(t, words))
            bits.append(bits_of(h, lanes))
            counts.append(len(h))
        return pa.StructArray.from_arrays([pa.array(bits, pa.binary()), pa.array(counts, pa.int64())], ["bits", "shingles"])

    return made(text)


class Forest:
    """Union-find over positions; a root is the smallest position of its set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _distances(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs at most ``radius`` bits apart; rows of ``a`` and ``b`` are lanes of 64 bits."""
    lanes = a.shape[1]
    # Half of the lanes sort out most pairs, unless random ones pass them as well.
    half = (lanes + 1) // 2 if radius < 15 * lanes else lanes
    apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint8 if half < 4 else np.uint16)
    for lane in range(1, half):
        apart += np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
    i, j = np.nonzero(apart <= radius)
    if half < lanes:
        whole = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64)
        near = whole <= radius
        i, j = i[near], j[near]
    return i, j


def near_pairs(lanes: np.ndarray, sizes: np.ndarray, side: np.ndarray, radius: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (positions) among the rows of a tile, or between the rows of two (``side`` 0 and 1).

    Stripes of rows sorted by population count and length skip the columns out of reach.
    """
    population = np.bitwise_count(lanes).sum(axis=1, dtype=np.int64)
    key = sizes if ratio else population
    order = np.argsort(key, kind="stable")
    left, right = order[side[order] == 0], order[side[order] == 1]
    alone = not len(right) or not len(left)
    if alone:
        left = right = order
    right_key = key[right]
    for at in range(0, len(left), STRIPE):
        rows = left[at : at + STRIPE]
        low, high = key[rows[0]], key[rows[-1]]
        lowest, highest = (low * ratio, high / ratio) if ratio else (low - radius, high + radius)
        a, b = np.searchsorted(right_key, lowest - 1e-9, "left"), np.searchsorted(right_key, highest + 1e-9, "right")
        columns = right[max(a, at if alone else 0) : b]
        i, j = _distances(lanes[rows], lanes[columns], radius)
        i, j = rows[i], columns[j]
        if ratio:
            alike = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
            i, j = i[alike], j[alike]
        yield i, j


def compare(lanes: np.ndarray, sizes: np.ndarray, side: np.ndarray, radius: int, ratio: float) -> np.ndarray:
    """Roots (positions) of the links in a tile or between two."""
    forest = Forest(len(lanes))
    for i, j in near_pairs(lanes, sizes, side, radius, ratio):
        forest.join(i, j)
    return forest.root


def _keys(lanes: np.ndarray, radius: int) -> list[np.ndarray]:
    """Group numbers of fingerprints of one lane: equal in some group if at most ``radius`` bits differ."""
    bits = lanes[:, 0]
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    masks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    out = []
    for number, (p, q) in enumerate(combinations(masks, 2)):
        k = (bits & np.uint64(p | q)) * np.uint64(0x9E3779B97F4A7C15)
        k ^= (k >> np.uint64(32)) ^ np.uint64(number * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        out.append((k * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    return out


def links(nodes: DataFrame, radius: int, lanes: int = 1, ratio: float = 0.0) -> DataFrame:
    """``(a, b)``: a spanning forest, or a little more, of the links among different ``(node, bits, size)``.

    Linked are nodes whose bits differ in at most ``radius`` places and whose sizes are within ``ratio``.
    """
    blocked = radius <= BLOCKED_RADIUS and lanes == 1
    step = log(1 / ratio) if ratio else 1.0

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column("bits").to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)
            size = b.column("size").to_numpy(zero_copy_only=False)
            population = np.bitwise_count(raw).sum(axis=1, dtype=np.int64) // max(radius, 1)
            length = (np.log(np.maximum(size, 1)) / step + 1e-9).astype(np.int64) if ratio else np.zeros(len(raw), np.int64)
            for k in _keys(raw, radius) if blocked else [np.zeros(len(raw), np.int64)]:
                yield pa.RecordBatch.from_arrays([pa.array(k), b.column("node"), b.column("bits"), b.column("size"),
                                                  pa.array(population), pa.array(length)], names=["key", "node", "bits", "size", "p", "l"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []
        for b in batches:
            rest.append(b.select(["key", "unit", "side", "node", "bits", "size"]))
            table = pa.Table.from_batches(rest).combine_chunks()
            unit = table["unit"].to_numpy()
            key = table["key"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (key[1:] != key[:-1])]))
            done = int(starts[-1])
            if done:
                yield from _edges(table.slice(0, done), starts)
            rest = table.slice(done).to_batches()
        if rest:
            table = pa.Table.from_batches(rest).combine_chunks()
            yield from _edges(table, np.array([0, len(table)]))

    def _edges(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, size, side = (table[c].to_numpy() for c in ("node", "size", "side"))
        raw = np.frombuffer(b"".join(table["bits"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)
        counts = np.diff(np.append(starts[starts < len(table)], len(table)))
        starts = starts[: len(counts)]
        a, b = [], []
        of = np.repeat(np.arange(len(counts)), counts)
        tiny = (counts <= TINY)[of]
        for shift in range(1, TINY):
            i = np.flatnonzero(tiny[:-shift] & (of[:-shift] == of[shift:])) if len(of) > shift else np.empty(0, np.int64)
            j = i + shift
            hit = np.bitwise_count(raw[i] ^ raw[j]).sum(axis=1, dtype=np.int64) <= radius
            if ratio:
                hit &= np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
            a.append(node[i[hit]])
            b.append(node[j[hit]])
        for g in np.flatnonzero(counts > TINY):
            part = slice(starts[g], starts[g] + counts[g])
            root = compare(raw[part], size[part], side[part], radius, ratio)
            linked = np.flatnonzero(root != np.arange(len(root)))
            a.append(node[part][linked])
            b.append(node[part][root[linked]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rows = nodes.select("node", "bits", "size").mapInArrow(grouped, "key long, node long, bits binary, size long, p long, l long")
    # Groups over the size of a tile are cut into tiles: by class of population count and length, then by hash.
    counts = rows.groupBy("key", "p", "l").agg(F.count("*").alias("n"))
    large = counts.groupBy("key").agg(F.sum("n").alias("all")).filter(F.col("all") > TILE).select("key")
    classes = materialize(
        counts.join(large, "key").select("key", "p", "l", F.ceil(F.col("n") / TILE).cast("int").alias("m")), "tiles")
    other = classes.select("key", F.col("p").alias("p2"), F.col("l").alias("l2"), F.col("m").alias("m2"))
    # Classes are as wide as the radius (and the ratio), so links stay within a class or lead to the next one.
    near = F.explode(F.array(*(F.struct(F.lit(dp).alias("dp"), F.lit(dl).alias("dl")) for dp, dl in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    pairs = (
        classes.withColumn("d", near)
        .select("key", "p", "l", "m", (F.col("p") + F.col("d.dp")).alias("p2"), (F.col("l") + F.col("d.dl")).alias("l2"))
        .join(other, ["key", "p2", "l2"])
    )
    pair = F.xxhash64("p", "l", "p2", "l2")
    same = (F.col("p") == F.col("p2")) & (F.col("l") == F.col("l2"))
    # For a row of the first class: with every tile of the second; for one of the second: with every tile of the first.
    roles = pairs.select("key", "p", "l", "m", F.lit(0).alias("side"), F.col("m2").alias("others"), pair.alias("pair"), same.alias("same")).union(
        pairs.filter(~same).select("key", F.col("p2").alias("p"), F.col("l2").alias("l"), F.col("m2").alias("m"), F.lit(1).alias("side"),
                                   F.col("m").alias("others"), pair.alias("pair"), F.lit(False).alias("same")))
    own = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    tile, with_ = F.col("tile"), F.col("with")
    cut = (
        rows.join(roles, ["key", "p", "l"])
        .withColumn("tile", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .withColumn("low", F.when(F.col("same"), F.least(tile, with_)).when(F.col("side") == 0, tile).otherwise(with_))
        .withColumn("high", F.when(F.col("same"), F.greatest(tile, with_)).when(F.col("side") == 0, with_).otherwise(tile))
        .withColumn("side", F.when(F.col("same"), (tile > with_).cast("int")).otherwise(F.col("side")))
        .select("key", F.xxhash64("pair", "low", "high").alias("unit"), "side", "node", "bits", "size")
    )
    whole = rows.join(large, "key", "left_anti").select("key", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side"), "node", "bits", "size")
    met = (whole.union(cut) if blocked else cut.union(whole)).repartition("key", "unit").sortWithinPartitions("key", "unit")
    return met.mapInArrow(compared, "a long, b long")


def clusters(fingerprints: DataFrame, radius: int, lanes: int = 1, ratio: float = 0.0) -> DataFrame:
    """``(bits, size, root)`` for all different ``(bits, size)``: ``root`` names the component."""
    node = F.conv(F.hex("bits"), 16, -10).cast("long") if lanes == 1 and not ratio else F.xxhash64("bits", "size")
    nodes = materialize(fingerprints.select("bits", "size").distinct().withColumn("node", node), "nodes")
    linked = components(links(nodes, radius, lanes, ratio))
    return nodes.join(linked, "node", "left").select("bits", "size", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row; the component is named by its smallest key."""
    made = docs.select(F.col(key).alias("__key"), fingerprint(text, words).alias("f"))
    made = materialize(made.select("__key", F.col("f.bits").alias("bits"), F.lit(0).cast("long").alias("size")), "fingerprints")
    roots = clusters(made, radius).select("bits", "root")
    least = made.groupBy("bits").agg(F.min("__key").alias("least")).join(roots, "bits")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("bits", "component_id")
    return made.join(named, "bits").select(F.col("__key").alias(key), F.lower(F.hex("bits")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest key stays.

    Components are those of ``near_duplicates``. A key that is null comes last, ties go to the smallest hash of the
    text, and of equal rows one stays.
    """
    row = F.xxhash64(F.col(key).cast("string"), F.col(text))
    made = docs.select(F.col(key).alias("__key"), row.alias("row"), fingerprint(text, words).alias("f"))
    made = materialize(made.select("__key", "row", F.col("f.bits").alias("bits"), F.lit(0).cast("long").alias("size")), "fingerprints")
    first = F.min(F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), "row")).alias("first")
    roots = clusters(made, radius).select("bits", "root")
    stay = made.groupBy("bits").agg(first).join(roots, "bits").groupBy("root").agg(F.min("first").alias("first"))
    mark = unused("row", docs)
    kept = docs.withColumn(mark, row).join(stay.select(F.col("first.row").alias(mark)), mark, "left_semi")
    return kept.dropDuplicates([mark]).select(*docs.columns)
