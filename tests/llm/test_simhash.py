"""Fingerprints and components against plain loops."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import docs, folder, odd  # noqa: F401

from velum.llm import simhash
from velum.llm.components import components
from velum.llm.queries import QUERIES


def plain_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_query_on_a_table(spark, sf):
    rows = QUERIES["op3_simhash"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert sorted(map(tuple, rows)) == [(i, f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots)]


def test_odd_rows(spark, docs, odd, folder):
    rows = QUERIES["op3_simhash"](spark, folder(documents=docs(odd, clash=True))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert len(rows) == len(odd)
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert by[5] == by[6] == by[None] and {c for _, c in by[5]} == {5}
    assert QUERIES["op3_simhash"](spark, folder(documents=docs([]))).collect() == []


def nodes(spark, values, lanes=1, sizes=None):
    rows = [(i, bytearray(b"".join(int(x).to_bytes(8, "big") for x in v)), (sizes or [0] * len(values))[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "node long, bits binary, size long")


def linked(df, n):
    found = {r.node: r.root for r in components(df).collect()}
    return [found.get(i, i) for i in range(n)]


@pytest.mark.parametrize("tile", [16, 8192])
@pytest.mark.parametrize("radius", [0, 3, 4, 9])
def test_links_of_any_radius_and_tile(spark, monkeypatch, tile, radius):
    """Small tiles cut a hot group: many neighbours of one fingerprint among others."""
    monkeypatch.setattr(simhash, "TILE", tile)
    pick = random.Random(radius)
    hot = pick.getrandbits(64)
    values = {hot}
    while len(values) < 250:
        values.add(hot ^ sum(1 << pick.randrange(64) for _ in range(pick.randint(0, 7))))
    values |= {pick.getrandbits(64) for _ in range(100)}
    values = sorted(v & (1 << 64) - 1 for v in values)
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= radius)
    got = linked(simhash.links(nodes(spark, [(v,) for v in values]), radius), len(values))
    assert got == want


@pytest.mark.parametrize("tile", [32, 8192])
def test_links_of_four_lanes_with_sizes(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    pick = random.Random(5)
    base = [pick.getrandbits(256) for _ in range(40)]
    values = [b ^ sum(1 << x for x in pick.sample(range(256), pick.randint(20, 60))) for b in base for _ in range(4)]
    sizes = [pick.randint(50, 90) for _ in values]
    near = lambda i, j: (values[i] ^ values[j]).bit_count() <= 51 and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])
    want = plain_components(range(len(values)), near)
    lanes = [[v >> s & (1 << 64) - 1 for s in (192, 128, 64, 0)] for v in values]
    assert linked(simhash.links(nodes(spark, lanes, 4, sizes), 51, 4, 0.8), len(values)) == want


def test_one_of_each(spark, docs):
    pick = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [pick.choice(words) for _ in range(900)]
    near = [*base[:450], "other", *base[451:]]
    far = [pick.choice(words) for _ in range(300)]
    rows = [(3, " ".join(base)), (2, " ".join(near)), (7, " ".join(base)), (7, " ".join(base)), (5, " ".join(far)), (None, " ".join(base)),
            (8, None), (9, ""), (1, "short text"), (30, "long " * 60_000), (31, "LONG " * 60_000), (31, "LONG " * 60_000)]
    df = docs(rows, clash=True).withColumns({"__row0": F.lit("mine"), "row": F.lit("mine"), "first": F.lit("mine")})
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    out = kept.collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 5, 8, 30] and {r["__row0"] for r in out} == {"mine"}
    assert simhash.one_of_each(docs([])).collect() == []
    assert [r.doc_id for r in simhash.one_of_each(docs([(None, "a b c"), (None, "a b c")])).collect()] == [None]


def test_one_of_each_against_plain_components(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    ids = sorted(texts)
    roots = plain_components([plain_fingerprint(texts[i]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == sorted({ids[r] for r in roots})


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bits_of_ties():
    assert simhash.bits_of(np.array([1, 0], np.uint64)) == bytes(8)
    assert simhash.bits_of(np.array([1, 1, 0], np.uint64)) == bytes(7) + b"\1"
