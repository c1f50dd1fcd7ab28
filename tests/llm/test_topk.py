"""Top-k against brute force."""

import math

import numpy as np
import pytest

from velum.llm import topk


def brute(rows, k, scale=1024):
    ok = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok[n] = (i, [math.floor(scale * x) for x in v])
    queries = {}
    for i, v in ok.values():
        if i % 100 == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, a in queries.items():
        s = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok.values() if i != q)[:k]
        out += [(q, n + 1, i, -m) for n, (m, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=10):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    return sorted(map(tuple, topk.top_k(df, df.filter(F.col("vec_id") % 100 == 0), k).collect()))


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "STEP", 5)
    pick = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in pick.normal(0, 0.2, 9)]) for i in range(700)]
    assert run(spark, rows) == brute(rows, 10)


def test_ties_nulls_and_few(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]),
            (7, []), (8, [2.0]), (9, [0.1, 0.2, 0.3]), (100, [0.0, 0.0]), (None, [1.0, 1.0]), (2, [1.0, 0.5])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, rows, 2) == brute(rows, 2)


def test_large_values_stay_exact(spark):
    rows = [(i, [2.0**17 + i, -(2.0**18)]) for i in range(0, 300, 25)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    pick = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in pick.normal(0, 0.2, 4)]) for i in range(0, 1000, 20)]
    assert run(spark, rows, 4) == brute(rows, 4)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(100, [1.0])]])
def test_nothing_to_find(spark, rows):
    assert run(spark, rows) == []


def test_the_bound_stops_early():
    pick = np.random.default_rng(1)
    vectors = pick.integers(0, 1000, (4000, 3)).astype(np.float64)
    lists = topk.Lists(np.arange(4000), vectors)
    seen = []
    original = topk._joined
    try:
        topk._joined = lambda best, scores, ids, own: seen.append(len(scores)) or original(best, scores, ids, own)
        scores, ids = lists.search(-1, np.array([1.0, 2.0, 3.0]), 5, (np.empty(0), np.empty(0, np.int64)))
    finally:
        topk._joined = original
    assert sum(seen) < 2000 and scores[0] == (vectors @ [1, 2, 3]).max()
