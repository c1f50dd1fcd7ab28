"""Decontamination: odd rows, spans and offsets; whole results are compared with SQL by ``tests/test_queries.py``."""

import random

from llm_fixtures import docs  # noqa: F401

from velum.llm import decontam


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


def found(spark, docs, items, texts, **kw):
    df = docs(list(enumerate(texts)), clash=True)
    rows = decontam.contamination(df, bench(spark, items), out="f", **kw).select("doc_id", "f").collect()
    return [r.f for r in sorted(rows)]


def test_words_runs_and_offsets(spark, docs):
    items = [("a", "Zwölf Boxkämpfer jagen"), ("b", "one, TWO three"), ("c", None), ("d", "..."), ("e", "one two three")]
    texts = ["x ZWölf\n boxkämpfer--jagen! y", "one two three two three", "none two three", None, "", "one two three one TWO Three " * 3000]
    got = found(spark, docs, items, texts, words=3)
    assert (got[0].n_words, got[0].n_hit, got[0].item_ids) == (5, 3, ["a"])
    raw = texts[0].encode()
    assert raw[got[0].spans[0].start : got[0].spans[0].end].decode() == "ZWölf\n boxkämpfer--jagen"
    assert (got[1].n_hit, got[1].item_ids, [tuple(s)[:2] for s in got[1].spans]) == (3, ["b", "e"], [(0, 2)])
    assert got[2].n_hit == 0 and got[3].n_words == got[4].n_words == 0
    assert got[5].n_hit == 18_000 and len(got[5].spans) == 1


def test_overlapping_windows(spark, docs):
    got = found(spark, docs, [("a", "a b c d")], ["a b c", "b c d x a b c d", "a a b c d d"], words=3)
    assert [g.n_hit for g in got] == [3, 7, 4]


def test_empty_tables(spark, docs):
    assert found(spark, docs, [], ["a b c"])[0].n_hit == 0
    assert found(spark, docs, [("a", "b")], []) == []


def test_a_benchmark_in_parts_gives_the_same(spark, docs, monkeypatch):
    """Above the size of an automaton: windows in parts, hits united, against one automaton."""
    pick = random.Random(3)
    prose = lambda n: " ".join(pick.choice(["Aa", "b", "c,", "dé", "e", "f", "g-h", "I"]) for _ in range(n))
    items = [(f"i{i}", prose(pick.randint(3, 12))) for i in range(40)] + [("none", None), ("i1", prose(9))]
    texts = [prose(pick.randint(0, 80)) for _ in range(60)] + [None, "", "zz"]
    whole = found(spark, docs, items, texts, words=4)
    monkeypatch.setattr(decontam, "MAX_WINDOWS", 30)
    assert found(spark, docs, items, texts, words=4) == whole
    assert sum(len(r.spans) > 1 for r in whole) > 5 and found(spark, docs, items, [], words=4) == []


def test_the_query_in_parts_equals_its_sql(spark, sf, monkeypatch):
    import duckdb

    from velum.llm.queries import ORACLES, QUERIES

    monkeypatch.setattr(decontam, "MAX_WINDOWS", 300)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, QUERIES["op8_decontamination"](spark, sf).collect())) == sorted(con.execute(ORACLES["op8_decontamination"]).fetchall())
