"""Toxicity, quality and language: held-out accuracy on the given table, and odd rows."""

import zlib

import numpy as np
import pytest

from llm_fixtures import docs, folder, odd  # noqa: F401

from velum.llm import langid, quality, toxicity
from velum.llm.linear import remainder
from velum.llm.queries import QUERIES
from velum.llm.tokens import WordIds

MID = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, query, label):
    got = QUERIES[query](spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got)
    return [r for r in got if r.held_out], label


def test_toxicity_held_out(spark):
    rows, _ = labelled(spark, "op6_toxicity", "toxic")
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * sum(r.toxic for r in rows)


def test_quality_held_out(spark):
    rows, _ = labelled(spark, "op1_quality", "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_language_held_out(spark):
    got = QUERIES["op9_language"](spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got} == {True, False} and np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_held_out_follows_the_checksum(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", remainder("doc_id", 4).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)


@pytest.mark.parametrize("query", ["op1_quality", "op6_toxicity"])
@pytest.mark.parametrize("labels", [[], [(4, 1, 1)], [(4, 1, 1), (5, 0, 0), (5, 0, 0), (6, None, None), (None, 1, 1), (99, 1, 0)]])
def test_odd_rows_and_few_labels(spark, docs, odd, folder, query, labels):
    d = folder(documents=docs(odd, clash=True), labels=spark.createDataFrame(labels, LABELS))
    rows = QUERIES[query](spark, d).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[1] == score[2] == score[3] and score[5] == score[6]


def test_empty_documents(spark, docs, folder):
    d = folder(documents=docs([]), labels=spark.createDataFrame([], LABELS))
    for query in ("op1_quality", "op6_toxicity", "op9_language"):
        assert QUERIES[query](spark, d).collect() == []


def test_languages_of_odd_rows(spark, docs, folder):
    rows = [(i, "the cat sat on the mat with words", "en") for i in range(20)] + [(100 + i, "der hund und die katze sind müde", "de") for i in range(20)]
    rows += [(200, None, "en"), (201, "123 !?", "de"), (202, "", "en"), (203, "und die katze", None), (204, "中文", None), (205, "the " * 50_000, "en")]
    got = {r.doc_id: r for r in QUERIES["op9_language"](spark, folder(documents=docs(rows, clash=True))).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (200, 201, 202))
    assert got[203].lang_pred == "de" and got[205].lang_pred == "en" and got[204].lang_pred in ("de", "en") and got[204].rejected
    assert {r.lang_pred for r in QUERIES["op9_language"](spark, folder(documents=docs([(1, "text", None)]))).collect()} == {"und"}


def test_l1_leaves_few_weights():
    model = toxicity.Ftrl(1 << 10, l1=2.0)
    pick = np.random.default_rng(1)
    for _ in range(300):
        y = int(pick.random() < 0.5)
        model.learn(np.unique(np.append(pick.integers(10, 1000, 20), [1] if y else [2])), y)
    w = model.weights(slice(None))
    assert w[1] > 0.5 and w[2] < -0.5 and (w != 0).mean() < 0.2


def test_skip_grams_tell_order_and_gap():
    ids = WordIds()
    a, b = (set(toxicity.features(t, ids).tolist()) for t in (b"you are bad", b"bad are you"))
    assert len(a & b) == 3 and len(a) == len(b) == 6


def test_dual_coordinate_descent_reaches_the_optimum():
    pick = np.random.default_rng(4)
    rows = [np.unique(pick.integers(0, 30, 6)) for _ in range(80)]
    signs = np.where([(r < 15).sum() * 2 >= len(r) for r in rows], 1.0, -1.0)
    w, b = quality.dual_coordinate_descent(rows, np.ones(30), signs, passes=500)

    def objective(w, b):
        return (w @ w + b * b) / 2 + sum(max(0, 1 - y * (w[r].sum() / np.sqrt(len(r)) + b)) for r, y in zip(rows, signs))

    best = objective(w, b)
    for _ in range(200):
        assert objective(w + pick.normal(0, 0.02, 30), b + pick.normal(0, 0.02)) >= best - 1e-3


def test_log_count_ratios():
    r = quality.log_count_ratios([np.array([0, 1]), np.array([1, 2])], np.array([1, 0]), 4)
    assert r[0] > 0 > r[2] and r[1] == 0 and r[3] == 0


def test_clusters_separate():
    x = np.repeat(np.eye(3, 8), 5, axis=0)
    assert sorted(map(tuple, langid.clustered(x, 3).round(6))) == sorted(map(tuple, np.eye(3, 8)))


def test_all_of_many_languages_are_learnt_from_one_row_an_id(spark, docs):
    from pyspark.sql import functions as F

    names = [f"l{i:02d}" for i in range(70)]
    rows = [(i * 100 + j, f"{chr(0x4e00 + i * 7) * 3} {chr(0x4e01 + i * 7) * 2}", y) for i, y in enumerate(names) for j in range(2)]
    rows += [(7, "b" * n, "hot") for n in range(1, 40)] + [(8, "123", "hot"), (9, None, "hot"), (10, "c d", "hot")]
    model = langid.fit(docs(rows), F.lit(True), rows=2, clusters=4)
    assert sorted(set(model["names"])) == ["hot", *names]
    assert model["names"].count("hot") == 2
