"""The registered queries: thin uses of the operators with production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm import bpe, decontam, hosts, langid, mixture, periodic, pseudonyms, quality, ranked, simhash, suffix_tree, topk, toxicity
from velum.llm.linear import held_out, remainder
from velum.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["QUERIES", "ORACLES"]

#: Where the public vocabularies are; a parameter of the deployment.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"


@query("op1_quality")
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("__key", 3) != 1)
    scored = docs.select("doc_id", held_out("doc_id", 3, 1), quality.score("text", model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: Key of the pseudonyms; a deployment passes its own secret.
KEY = "registered-query-key"


@query("op2_pii_pseudonyms")
def op2_pii_pseudonyms(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", pseudonyms.pseudonymised("text", KEY).alias("made"))
    return made.select("doc_id", "made.text", F.col("made.replaced").alias("n_replaced"))


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark, sf_dir):
    vocabulary = bpe.read_vocabulary(spark, os.path.join(TOKENIZERS, VOCABULARY))
    both = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text", vocabulary).alias("both"))
    return both.select(
        "doc_id",
        (F.length("both.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )


@query("op5_suffix_tree")
def op5_suffix_tree(spark, sf_dir):
    made = suffix_tree.scores(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return made.select("doc_id", held_out("doc_id", 10, 0), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("__key", 4) != 2)
    scored = docs.select("doc_id", held_out("doc_id", 4, 2), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q JOIN v ON q.query_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op7_topk", OP7_SQL)
def op7_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


#: Words and windows in SQL; ``regexp_replace`` lower-cases nothing, so A-Z is lowered by ``translate``.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_words(text: str) -> str:
    plain = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    return rf"regexp_extract_all({plain}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_sql_words('text')} AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 10) AS k, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS b, w FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, b, b + k - 1), ' ') AS win FROM p),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, k, unnest(generate_series(1, len(w) - k + 1)) AS b, w FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT r, b, k, item_id FROM (SELECT r, b, k, array_to_string(list_slice(w, b, b + k - 1), ' ') AS win FROM places) JOIN windows USING (k, win)),
words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(b, b + k - 1)) AS pos FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op8_decontamination", OP8_SQL)
def op8_decontamination(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.item_ids", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query("op9_language")
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("__key", 4) != 2)
    found = docs.select("doc_id", held_out("doc_id", 4, 2), langid.predict("text", model, spark).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")


#: The rules of the contract: verdict, host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query("op10_url_verdicts")
def op10_url_verdicts(spark, sf_dir):
    return hosts.verdicts(table(spark, sf_dir, "pages"), RULES)


@query("op11_source_mix")
def op11_source_mix(spark, sf_dir):
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_sql_words('text')}) AS w FROM benchmark),
c AS (SELECT count(*) AS docs, sum(len(w)) AS words FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
v AS (SELECT r, doc_id, 10 + (90 * len(w) * docs) // words AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT i, item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM (SELECT i, item_id, unnest(w) AS term FROM i) JOIN f USING (term) JOIN p USING (term) JOIN v USING (r) GROUP BY i, item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_ranked_search", OP12_SQL)
def op12_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _with_repeats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text by the contract: one in ten documents, by the hash of its id, repeats its own words from some place on."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select(key, F.col(text).alias("text"), F.floor(h / 10).alias("g"), words.alias("w"))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    rest = F.col("n") - F.col("a")
    # No lambda here: Spark does not run a Python function on an argument that holds one.
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    repeated = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")
    return rows.select(key, F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = _with_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = found.select("doc_id", periodic.periodic_runs("text").alias("found")).select("doc_id", "found.runs", "found.collapsed")
    # The longest run, then the first, then the one with the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
