"""Entropy balancing: targets, rates and copies against plain versions."""

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from llm_fixtures import DOCS, docs, folder, odd  # noqa: F401
from conftest import plan_of

from velum.llm import mixture
from velum.llm.queries import QUERIES


def plain_targets(sizes, most=3):
    """Share by weight; who is over its bound stops there and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= full
    return out


def plain_rates(sizes, target, most=3):
    """The multiplier by bisection."""
    if target >= most * sum(sizes):
        return [float(most)] * len(sizes)
    rates = lambda x: [min(float(most), math.exp(min(50, x * s))) for s in sizes]
    low, high = -60.0, 2.0
    for _ in range(300):
        mid = (low + high) / 2
        if sum(s * r for s, r in zip(sizes, rates(mid))) < target:
            low = mid
        else:
            high = mid
    return rates(low)


def made_rows(seed=1, n=1200):
    pick = random.Random(seed)
    names = ["b", "a", None, "z\U0001F600", "z￿", "", "hot", "tiny", "void"]
    rows = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else pick.choice(names[:6])
        rows.append((i, " ".join(["w"] * int(pick.lognormvariate(3, 1))), "en", s, 0))
    rows += [(n + 1, "w " * 30_000, "en", "hot", 0), (n + 2, "one two", "en", "tiny", 0), (n + 3, None, "en", "void", 0), (n + 4, "", "en", "void", 0)]
    return rows + [(5, "same words here", "en", "hot", 0)] * 300 + [(None, "x y", "en", "a", 0)] * 40


def by_source(rows, got):
    """Sources of the mixed rows, by key and size."""
    of = {(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[3] for r in rows}
    out = defaultdict(list)
    for r in got:
        out[of[r.doc_id, r["size"]]].append(r)
    return out


def test_targets_rates_and_copies(spark):
    rows = made_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = mixture.mix(df).collect()
    assert len(got) == len(rows)
    sources = by_source(rows, got)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in sources.items()}
    want = plain_targets(sizes)
    for s, rs in sources.items():
        assert {r.source_size for r in rs} == {sizes[s]}
        assert all(abs(r.target - want[s]) <= 1e-9 * max(1, want[s]) for r in rs)
        assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in rs)
        some = [r for r in rs if r["size"]]
        for r, rate in zip(some, plain_rates([r["size"] for r in some], want[s])):
            assert abs(r.rate - rate) < 1e-5, (s, r, rate)
        taken = sum(r.taken for r in rs)
        assert abs(taken - want[s]) <= (0 if want[s] == 3 * sizes[s] else 5), (s, taken, want[s])
    # All documents of a size get the same number of copies, or one more.
    of_size = defaultdict(list)
    for s, rs in sources.items():
        for r in rs:
            of_size[s, r["size"]].append(r.copies)
    assert all(max(c) - min(c) <= 1 for c in of_size.values())
    assert all(abs(sum(c) / len(c) - next(r.rate for r in sources[s] if r["size"] == n)) * len(c) <= 9 for (s, n), c in of_size.items() if n)


def test_reruns_agree_in_any_order_and_partitioning(spark):
    df = spark.createDataFrame(made_rows(2, 500), DOCS)
    runs = [sorted(map(str, mixture.mix(df.repartition(p)).collect())) for p in (1, 7)]
    assert runs[0] == runs[1]


def test_odd_rows_clashing_columns_and_texts(spark, docs, odd):
    df = docs(odd, clash=True).withColumn("size", F.lit("x"))
    got = mixture.mix(df, keep=("doc_id", "text", "size", "rank")).collect()
    assert len(got) == len(odd) and all(r["rank"] == "x" for r in got)
    assert sum(r.taken for r in got) == sum(r["size"] for r in got) == 60_000 + 3 * 6 + 1 + 5 + 2
    mixed = mixture.repeated(mixture.mix(df, keep=("doc_id", "text")))
    assert mixed.count() == sum(r.copies for r in mixture.mix(df).collect())
    assert mixture.mix(docs([])).collect() == []
    assert [r.taken for r in mixture.mix(docs([(1, None), (2, " ")])).collect()] == [0, 0]


def test_the_query_is_native_and_meets_its_targets(spark, sf):
    df = QUERIES["op11_source_mix"](spark, sf)
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)
    got = df.collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [(k, r.text, r.lang, r.source, 0) for k, r in texts.items()]
    sources = by_source(rows, got)
    want = plain_targets({s: sum(r["size"] for r in rs) for s, rs in sources.items()})
    for s, rs in sources.items():
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(2, 0.02 * want[s]) and all(r.taken <= 3 * r["size"] for r in rs)
        assert abs(rs[0].target - want[s]) < 1e-6
