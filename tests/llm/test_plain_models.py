"""The scores of the three classifiers against plain versions: dictionaries and loops, no hashing shortcuts but the bucket numbers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, folder, odd  # noqa: F401

from velum.llm import langid, quality, toxicity
from velum.llm.queries import QUERIES

M = 0xFFFFFFFF
LABELS = "doc_id long, quality int, toxic int"


def bucket(parts, kind, bits):
    h = kind * 0x85EBCA6B & M
    for p in parts:
        h = (h ^ p) * 0x9E3779B1 & M
        h ^= h >> 15
    return (h * 0xC2B2AE35 & M) >> (32 - bits)


def remainder(key, n):
    return None if key is None else zlib.crc32(str(key).encode()) % n


def sigmoid(x):
    return 1 / (1 + math.exp(-min(max(x, -35), 35)))


def order_of(spark, keys):
    rows = spark.createDataFrame([(k,) for k in keys if k is not None], "k long").select("k", F.xxhash64("k").alias("h")).collect()
    return {r.k: r.h for r in rows}


def sample(spark, rows, labels, train):
    """Labelled rows by the order of the id's hash: one text an id, the smallest; the greatest label."""
    label, text = {}, {}
    for key, y in labels:
        if key is not None and y is not None and train(key):
            label[key] = max(label.get(key, y), y)
    for key, t in rows:
        if key in label:
            text[key] = min(text.get(key, t or ""), t or "")
    h = order_of(spark, text)
    return [(text[k], label[k]) for k in sorted(text, key=h.__getitem__)]


def toxic_features(text):
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text).split(" ")
    ids = [zlib.crc32(w.encode()) for w in words if w]
    out = {bucket([a], 1, toxicity.BITS) for a in ids}
    for gap in (1, 2, 3):
        out |= {bucket(p, 1 + gap, toxicity.BITS) for p in zip(ids, ids[gap:])}
    return out


def plain_toxicity(spark, rows, labels):
    z, n, z0, n0 = defaultdict(float), defaultdict(float), 0.0, 0.0
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    train = sample(spark, rows, labels, lambda k: remainder(k, 4) != 2)
    for _ in range(toxicity.PASSES):
        for text, y in train:
            at = toxic_features(text)
            w = {i: weight(i) for i in at}
            w0 = -z0 / ((beta + math.sqrt(n0)) / alpha)
            g = sigmoid(sum(w.values()) + w0) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / alpha * w0
            n0 += g * g
    bias = -z0 / ((beta + math.sqrt(n0)) / alpha)
    return [sigmoid(sum(weight(i) for i in toxic_features(t or "")) + bias) for _, t in rows]


def shape(word):
    kinds = ["A" if c.isascii() and c.isupper() else "a" if not c.isascii() or c.islower() else "0" if c.isdigit() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)


def quality_features(text):
    words = text.split()
    a, s = [zlib.crc32(w.encode()) for w in words], [zlib.crc32(shape(w).encode()) for w in words]
    grams = [(1, zip(a)), (2, zip(s)), (3, zip(a, a[1:])), (4, zip(s, s[1:])), (5, zip(s, s[1:], s[2:]))]
    out = {bucket(p, kind, quality.BITS) for kind, parts in grams for p in parts}
    return out | {bucket([sum((a[i] == a[i + k]) << k for k in (1, 2, 3))], 6, quality.BITS) for i in range(len(a) - 3)}


def plain_quality(spark, rows, labels):
    train = [(quality_features(t), y) for t, y in sample(spark, rows, labels, lambda k: remainder(k, 3) != 1)]
    counts = [Counter(f for at, y in train if y == k for f in at) for k in (0, 1)]
    size = 1 << quality.BITS
    q, p = (sum(c.values()) + size * quality.SMOOTHING for c in counts)
    ratio = {f: math.log((counts[1][f] + quality.SMOOTHING) / p / ((counts[0][f] + quality.SMOOTHING) / q)) for f in counts[0].keys() | counts[1].keys()}

    def vector(at):
        v = {f: ratio[f] for f in at if f in ratio}
        norm = max(math.sqrt(sum(x * x for x in v.values())), 1e-12)
        return {f: x / norm for f, x in v.items()}

    w, b, alpha = defaultdict(float), 0.0, [0.0] * len(train)
    vectors = [vector(at) for at, _ in train]
    order = np.random.default_rng(7)
    for _ in range(quality.PASSES):
        moved = 0.0
        for i in order.permutation(len(train)):
            sign, v = 2 * train[i][1] - 1, vectors[i]
            gradient = sign * (sum(w[f] * x for f, x in v.items()) + b) - 1
            new = min(max(alpha[i] - gradient / (sum(x * x for x in v.values()) + 1), 0), quality.COST)
            step = (new - alpha[i]) * sign
            if step:
                for f, x in v.items():
                    w[f] += step * x
                b += step
                moved, alpha[i] = max(moved, abs(step)), new
        if moved < 1e-3:
            break
    return [sigmoid(2 * (sum(w[f] * x for f, x in vector(quality_features(t or "")).items()) + b)) for _, t in rows]


def made(seed=1):
    """Texts of two kinds and some odd ones, labelled with noise."""
    pick = random.Random(seed)
    rows, labels = [], []
    for i in range(160):
        bad = i % 3 == 0
        words = [pick.choice(["vile", "Filth", "scum!", "BUY", "x9x"] if bad and pick.random() < 0.3 else ["alpha", "Beta,", "gamma", "über", "d3lta."])
                 for _ in range(pick.randint(3, 30))]
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, int(not bad) if pick.random() < 0.95 else int(bad), int(bad)))
    rows += [(7, "a repeated id"), (None, "no id vile filth"), (300, None), (301, "  ")]
    return rows, labels + [(7, 0, 1), (None, 1, 1), (9, None, None)]


@pytest.mark.parametrize("query, plain, column", [("op6_toxicity", plain_toxicity, 2), ("op1_quality", plain_quality, 1)])
def test_scores(spark, docs, folder, monkeypatch, query, plain, column):
    monkeypatch.setattr(toxicity, "L1", 1.0)
    monkeypatch.setattr(toxicity.Ftrl.__init__, "__defaults__", (toxicity.ALPHA, toxicity.BETA, 1.0, toxicity.L2))
    rows, labels = made()
    d = folder(documents=docs(rows, clash=True), labels=spark.createDataFrame(labels, LABELS))
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in QUERIES[query](spark, d).collect())
    want = sorted((str(k), round(s, 4)) for (k, _), s in zip(rows, plain(spark, rows, [(x[0], x[column]) for x in labels])))
    assert len({s for _, s in want}) > 50
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 2e-3 for g, w in zip(got, want))


def gram_counts(text):
    raw = b" " + b" ".join(bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()).split()) + b" "
    out = Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(raw) - n + 1):
            out[bucket([int.from_bytes(raw[i : i + n], "big")], n, langid.BITS)] += 1
    return {f: math.log1p(c) for f, c in out.items()}


def unit(v):
    norm = max(math.sqrt(sum(x * x for x in v.values())), 1e-12)
    return {f: x / norm for f, x in v.items()}


def dot(a, b):
    return sum(x * b.get(f, 0.0) for f, x in a.items())


def plain_languages(spark, rows):
    """Centroids by k-means in dictionaries; the language and cosine of every text."""
    texts = {}
    for key, text, lang in rows:
        if key is not None and lang is not None and text and any(map(str.isalpha, text)) and remainder(key, 4) != 2:
            texts[key, lang] = min(texts.get((key, lang), text), text)
    h = order_of(spark, {k for k, _ in texts})
    seen, total = Counter(f for t in texts.values() for f in gram_counts(t)), len(texts)
    idf = lambda f: math.log((1 + total) / (1 + seen[f]))
    centres = []
    for lang in sorted({lang for _, lang in texts}):
        own = sorted(((h[k], t) for (k, x), t in texts.items() if x == lang))
        vectors = [unit({f: x * idf(f) for f, x in gram_counts(t).items()}) for _, t in own]
        c = vectors[:1]
        while len(c) < min(langid.CLUSTERS, len(vectors)):
            c.append(min(vectors, key=lambda v: max(dot(v, k) for k in c)))
        for _ in range(langid.ROUNDS):
            groups = defaultdict(list)
            for v in vectors:
                groups[max(range(len(c)), key=lambda k: (dot(v, c[k]), -k))].append(v)
            for k, members in groups.items():
                total_ = Counter()
                for v in members:
                    total_.update(v)
                c[k] = unit(total_)
        centres += [(lang, k) for k in c]
    out = []
    for _, text, _ in rows:
        if text is None or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        v = unit({f: x * idf(f) for f, x in gram_counts(text).items()})
        best = max(range(len(centres)), key=lambda i: (dot(v, centres[i][1]), -i))
        out.append((centres[best][0], max(dot(v, centres[best][1]), 0.0)))
    return out


def test_languages(spark, docs, folder):
    pick = random.Random(2)
    syllables = {"en": ["the", "ing", "ou", "th"], "fr": ["eau", "é", "oui", "que"], "xx": ["zka", "ło", "szcz", "ny"]}
    rows = [(i, " ".join("".join(pick.choice(syllables[lang]) for _ in range(2)) for _ in range(pick.randint(2, 12))), lang)
            for i in range(90) for lang in [pick.choice(list(syllables))]]
    rows += [(200, None, "en"), (201, "123 !", "fr"), (None, "theing the", "en"), (202, "theing", None), (3, "repeated id", rows[3][2])]
    d = folder(documents=docs(rows, clash=True))
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in QUERIES["op9_language"](spark, d).collect())
    want = sorted((str(k), lang, score) for (k, *_), (lang, score) in zip(rows, plain_languages(spark, rows)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, want))


def test_a_null_id_is_not_held_out(spark, docs, odd, folder):
    d = folder(documents=docs(odd), labels=spark.createDataFrame([], LABELS))
    for query in ("op1_quality", "op5_suffix_tree", "op6_toxicity", "op9_language"):
        rows = QUERIES[query](spark, d).collect()
        assert all(r.held_out is not None for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {False}
