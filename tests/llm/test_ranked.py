"""Ranked search: against plain sums, above the size of a block of queries, ties and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np

from llm_fixtures import docs, odd  # noqa: F401

from velum.llm import ranked


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, k=10):
    held = [(key, Counter(words(t))) for key, t in rows]
    held = [(key, c) for key, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, score string")


def found(df, items, **kw):
    return sorted(map(tuple, ranked.search(df, items, **kw).collect()), key=str)


def made(seed, n, size=40):
    pick = random.Random(seed)
    return [(i, " ".join(f"w{int(pick.paretovariate(0.6))}" for _ in range(pick.randint(1, size)))) for i in range(n)]


def test_many_queries_in_several_blocks_and_small_shards(spark, docs, monkeypatch):
    rows, items = made(1, 600), made(2, 60, 25)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 150)
    got = found(docs(rows, clash=True).repartition(3), bench(spark, [(*i, "x") for i in items]), k=7)
    assert got == plain(rows, items, 7)


def test_ties_repeats_nulls_and_long_texts(spark, docs, odd):
    rows = odd + [(i, "tie of words") for i in (40, 12, None, 31, 12)] + [(50 + i, "tie of words") for i in range(12)]
    items = [(1, "TIE words"), (1, "same text"), (2, None), (3, "..."), (4, "x" * 120_000), (5, "naïve 中文 straße long"), (None, "one"), (6, "absent")]
    assert found(docs(rows, clash=True), bench(spark, [(*i, "x") for i in items])) == plain(rows, items)


def test_empty_tables(spark, docs):
    assert found(docs([]), bench(spark, [(1, "a", "x")])) == []
    assert found(docs([(1, "a")]), bench(spark, [])) == []
    assert found(docs([(1, None)]), bench(spark, [(1, "a", "x")])) == []


def shard(seed, n=900, terms=300):
    pick = np.random.default_rng(seed)
    values = np.where(pick.random((n, terms)) < 0.04, pick.integers(1, 10**6, (n, terms)), 0).astype(np.int32)
    # Topics: documents of one share some terms of their own with high values.
    for topic in range(9):
        values[topic::9, topic * 5 : topic * 5 + 5] = pick.integers(9 * 10**5, 10**6, (len(values[topic::9]), 5))
    items = [np.unique(np.concatenate([np.arange(t * 5, t * 5 + 5), pick.integers(0, terms, 4)])) for t in range(9)]
    return values, items, pick.integers(1, 9000, terms).astype(np.int64)


def test_blocks_are_skipped_and_nothing_is_lost():
    scored = 0
    queries = best = None
    for seed in range(4):
        values, items, weights = shard(seed) if seed == 0 else (shard(seed)[0], items, weights)
        if best is None:
            queries, best = ranked.Queries(items, weights), ranked.Best(len(items), 10)
            projection = np.random.default_rng(7).standard_normal((len(weights), 24)).astype(np.float32)
            everything = []
        doc = np.arange(len(values)) + 1000 * seed
        everything.append((values, doc))
        scored += ranked.search_shard(values, doc, np.zeros(len(doc), bool), queries, best, projection)
    for q, t in enumerate(items):
        score = np.concatenate([v[:, t].astype(np.int64) @ weights[t] for v, _ in everything])
        doc = np.concatenate([d for _, d in everything])
        order = np.lexsort((doc, -score))[:10]
        assert best.doc[q].tolist() == doc[order].tolist() and best.score[q].tolist() == score[order].tolist()
    reached = sum(int((v[:, t] > 0).any(axis=1).sum()) for v, _ in everything for t in items)
    assert scored < 0.8 * reached
