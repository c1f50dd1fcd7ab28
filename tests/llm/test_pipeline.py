"""The pipeline's stages: what goes, what stays, and odd rows."""

import random

import pytest

from llm_fixtures import docs, folder  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline as C

LABELS = "doc_id long, quality int, toxic int"


def prose(seed, n=120):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(n))


@pytest.fixture
def corpus(spark, docs, folder):
    leak = prose(900, 30)
    rows = [(i, prose(i, 1500 if i == 1 else 120)) for i in range(60)]
    rows += [(100 + i, f"{prose(100 + i)} vile{i % 2} filth") for i in range(40)]
    rows += [(200, prose(0)), (201, prose(1, 1500) + " end"), (202, f"{prose(202)} {leak} {prose(203)}"), (203, "call 97.51.17.173 now"), (204, None), (205, "")]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(40)]
    bench = spark.createDataFrame([("b", leak)], "item_id string, text string")
    return folder(documents=docs(rows, clash=True), labels=spark.createDataFrame(labels, LABELS), benchmark=bench)


def test_stages(spark, corpus):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    gone = {"toxicity": set(range(100, 140)), "near_duplicates": {200, 201, 205}, "decontamination": {202}, "pii": set(), "bpe": set()}
    for name, stage in C.STAGES:
        out = stage(spark, docs, corpus)
        added = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] if name == "bpe" else []
        assert out.columns == [c for c in docs.columns if c not in added] + added
        out = out.cache()
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids - kept == gone[name], name
        docs, ids = out, kept
    ip = docs.filter("doc_id = 203").first()
    assert ip.text != "call 97.51.17.173 now" and ip.text.startswith("call ") and ip.n_chars == len(ip.text)


def test_run_gives_the_same_rows_again(spark, corpus):
    first, second = (sorted(map(str, C.run(spark, corpus).collect())) for _ in range(2))
    assert first == second and len(first) == 62


def test_odd_rows(spark, docs, folder):
    """Null ids and texts, blank, very long and repeated rows: each stage keeps clean ones, one of each group."""
    leak = prose(900, 30)
    rows = [(None, prose(1)), (None, prose(2)), (5, None), (6, " \n"), (7, "word " * 40_000), (8, "y" * 200_000), (8, "y" * 200_000), (9, prose(3)), (9, prose(3)),
            (9, prose(4)), (None, None), (10, leak)]
    bench = spark.createDataFrame([("b", leak)], "item_id string, text string")
    d = folder(documents=docs(rows, clash=True), labels=spark.createDataFrame([], LABELS), benchmark=bench)
    got = sorted((str(r.doc_id), len(r.text or "")) for r in C.run(spark, d).collect())
    assert got == sorted([("None", len(prose(1))), ("None", len(prose(2))), ("5", 0), ("7", 200_000), ("8", 200_000), ("9", len(prose(3))), ("9", len(prose(4)))])


def test_empty_tables(spark, docs, folder):
    d = folder(documents=docs([]), labels=spark.createDataFrame([], LABELS), benchmark=spark.createDataFrame([], "item_id string, text string"))
    assert C.run(spark, d).collect() == []


def test_registered():
    assert "pipeline" in entry.queries() and len([n for n in entry.queries() if n.startswith("op")]) == 13
