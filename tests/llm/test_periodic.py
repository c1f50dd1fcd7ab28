"""Periodic runs: against the definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np

from llm_fixtures import docs, folder, odd  # noqa: F401

from velum.llm import periodic
from velum.llm.queries import QUERIES


def plain_runs(words):
    """All runs by the definition: each period, each longest stretch, if no smaller period fits it."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            smaller = any(all(a == b for a, b in zip(stretch, stretch[d:])) for d in range(1, q))
            if len(stretch) >= max(6, 4 * q) and not smaller:
                found.append((start, len(stretch), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(n=250):
    for seed in range(n):
        pick = random.Random(seed)
        words = []
        for _ in range(pick.randint(1, 6)):
            root = [pick.choice("abc" if seed % 2 else "abcdefgh") for _ in range(pick.randint(1, 24))]
            words += (root * pick.randint(1, 9))[: pick.randint(1, 90)]
        yield words


def test_the_definition_on_random_texts():
    for words in random_texts():
        numbers = np.unique(words, return_inverse=True)[1].astype(np.int64)
        assert [tuple(map(int, r)) for r in periodic.runs_of(numbers)] == plain_runs(words), words


def test_words_of_two_letters_in_all_ways():
    for bits in range(1 << 12):
        words = [bits >> i & 1 for i in range(12)]
        assert [tuple(map(int, r)) for r in periodic.runs_of(np.array(words, np.int64))] == plain_runs(words)


def test_long_runs_take_no_quadratic_time():
    one = np.zeros(400_000, np.int64)
    assert periodic.runs_of(one).tolist() == [[0, 400_000, 1]]
    many = np.tile(np.arange(1000), 400)
    assert periodic.runs_of(many).tolist() == [[0, 400_000, 1000]]


def test_odd_rows_and_clashing_columns(spark, docs, odd):
    df = docs(odd + [(10, "a b " * 5 + "x"), (11, "z " + "c  d\te\n" * 4)], clash=True)
    got = {r.doc_id: r for r in df.select("doc_id", "text", periodic.periodic_runs("text").alias("runs_")).collect()}
    for r in got.values():
        words = split(r.text)
        assert r.runs_.n_words == len(words)
        if len(words) < 100:
            assert [tuple(x) for x in r.runs_.runs] == plain_runs(words)
            assert r.runs_.collapsed == " ".join(plain_collapsed(words, plain_runs(words)))
    assert [tuple(x) for x in got[8].runs_.runs] == [(0, 60_000, 1)] and got[8].runs_.collapsed == "long"
    assert got[1].runs_.collapsed == "" and got[10].runs_.collapsed == "a b x"
    assert docs([]).select(periodic.periodic_runs("text")).collect() == []


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, split(text))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(plain_collapsed(words, runs))))


def test_the_query_against_the_contract(spark, docs, folder, odd):
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choice("abcdefg") for _ in range(pick.randint(0, 70)))) for i in range(400)]
    rows += [(i, "" if i % 2 else None) for i in range(400, 440)]
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate(random_texts(60))] + [r for r in odd if len(r[1] or "") < 1000]
    d = folder(documents=docs(rows, clash=True))
    got = QUERIES["op13_periodic_runs"](spark, d).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                                          "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_given_documents(spark, sf):
    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        if len(split(texts[r.doc_id])) <= 400:
            assert tuple(r)[:8] == expected(r.doc_id, texts[r.doc_id])
