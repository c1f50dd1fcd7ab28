"""Suffix-tree scores: the base against plain loops, the tree's probabilities, and odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, folder, odd  # noqa: F401

from velum.llm import suffix_tree
from velum.llm.queries import QUERIES


def words(text):
    return (text or "").encode().lower().split() + [b""]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def check_base(rows, texts):
    counts = Counter()
    for i, t in texts:
        if not held(i):
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
                    round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 4)) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str) == want


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_suffix_tree"](spark, folder).collect()
    check_base(rows, [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
    assert all(r.held_out == held(r.doc_id) for r in rows)
    mine = [r for r in rows if r.held_out]
    assert sum(r.score for r in mine) > 0.9 * sum(r.base_score for r in mine)
    assert all(r.score < 0 for r in rows)


def test_odd_rows(spark, docs, odd, folder, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 20)
    rows = QUERIES["op5_suffix_tree"](spark, folder(documents=docs(odd, clash=True))).collect()
    check_base(rows, odd)
    assert all(math.isfinite(r.score) for r in rows)
    assert QUERIES["op5_suffix_tree"](spark, folder(documents=docs([]))).collect() == []


def test_nothing_to_learn_from(spark, docs, folder):
    ids = [i for i in range(100) if held(i)][:3]
    rows = QUERIES["op5_suffix_tree"](spark, folder(documents=docs([(i, "a b") for i in ids]))).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


class Plain:
    """The tree with dictionaries and loops, contexts as tuples of words, ``None`` for a rare next word."""

    def __init__(self, texts, min_context, depth):
        learnt = [words(t) for _, t, train in texts if train]
        self.c = Counter(w for t in learnt for w in t)
        self.n, self.depth, self.min = sum(self.c.values()), depth, min_context
        once, twice = (sum(v == k for v in self.c.values()) for k in (1, 2))
        self.discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        self.kept = {}
        for level in range(1, depth + 1):
            follow = defaultdict(Counter)
            for t in learnt:
                for i, w in enumerate(t):
                    g = self.context(t, i, level)
                    if g is not None:
                        follow[g][w] += 1
            for g, nexts in follow.items():
                total = sum(nexts.values())
                if total < min_context or any(self.c[w] < suffix_tree.MIN_NEXT for w in g):
                    continue
                own = {w: v for w, v in nexts.items() if self.c[w] >= suffix_tree.MIN_NEXT}
                entries = {w: v for w, v in own.items() if v >= suffix_tree.MIN_NEXT}
                if not entries:
                    continue
                lower = {w: round(-20 * math.log10(self.p(g[1:], w))) / -20 for w in entries}
                s, mass = sum(entries.values()), sum(10 ** v for v in lower.values())
                gain = sum(v * (math.log(v / total) - lower[w] * math.log(10)) for w, v in entries.items())
                if total > s:
                    gain += (total - s) * math.log((total - s) / total / max(1 - mass, 1e-9))
                if gain > 0.5 * len(entries) * math.log(self.n):
                    self.kept[g] = (entries, total, len(own), s)

    @staticmethod
    def context(text, i, level):
        """The ``level`` words before place ``i``; an end stands before the first word."""
        before = [b""] + text[:i]
        return tuple(before[-level:]) if len(before) >= level else None

    def p(self, g, w):
        if not g:
            seen = sum(v > 0 for v in self.c.values())
            return (self.c[w] - self.discount if self.c[w] else self.discount * seen) / self.n
        lower = self.p(g[1:], w)
        if g not in self.kept:
            return lower
        entries, total, d, s = self.kept[g]
        return entries.get(w, 0) / (total + d) + (total + d - s) / (total + d) * lower

    def score(self, text):
        t = words(text)
        return sum(math.log10(self.p(self.context(t, i, min(self.depth, i + 1)), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("hot", [1 << 22, 30])
@pytest.mark.parametrize("depth", [1, 3])
def test_scores_equal_a_plain_tree(spark, docs, monkeypatch, depth, hot):
    """Many blocks and shards, with and without contexts that are dealt by pairs."""
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(suffix_tree, "SHARD_WORDS", 500)
    monkeypatch.setattr(suffix_tree, "SHARD_TOKENS", 1_500)
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    pick = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, "the end"), (2, "the end"), (3, "Only once SEEN")]
    for i in range(4, 300):
        text = []
        while len(text) < 40:
            r = pick.random()
            text += ["c", "a", "d"] if r < 0.2 else ["a", "B"] if r < 0.5 else ["x", "y", "z"] if r < 0.6 else [f"w{pick.geometric(0.05)}"]
        rows.append((i, " ".join(text)))
    train = F.col("doc_id") % 5 != 0
    plain = Plain([(i, t, i % 5 != 0) for i, t in rows], 8, depth)
    found = suffix_tree.scores(docs(rows), train, min_context=8, depth=depth).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in found) == sorted((i, round(plain.score(t), 6)) for i, t in rows)
    assert (b"a",) in plain.kept and (depth == 1 or (b"c", b"a") in plain.kept)
    assert plain.p((b"c", b"a")[-depth:], b"d") > (0.9 if depth > 1 else 0.2)


def test_probabilities_of_a_state_sum_to_one():
    texts = [(i, "a b a c a b d e"[: 5 + i % 11], True) for i in range(200)]
    plain = Plain(texts, 5, 2)
    assert plain.kept
    for g in plain.kept:
        assert abs(sum(plain.p(g, w) for w in [*plain.c, b"never seen"]) - 1) < 1e-9


def test_the_tree_grows_with_the_corpus(spark, docs):
    """Twice as many different words, each with a next word of its own, are twice as many contexts."""
    def counted(count):
        rows = [(i * 60 + j, f"a{i} b{i}") for i in range(count) for j in range(60)]
        found = {r.doc_id: r for r in suffix_tree.scores(docs(rows), F.lit(True)).collect()}
        # Behind its own word the next one is all but certain, so a text costs little more than its first word.
        return sum(r.score > r.base_score / 2.2 for r in found.values())

    kept = [counted(n) for n in (20, 40)]
    assert kept == [20 * 60, 40 * 60]
