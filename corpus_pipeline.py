"""The corpus pipeline: documents to token sequences in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all rows that the stage before it kept,
and is written as Parquet and read again before the next one. All but the last return the columns of
``docs``, the last adds tokens. Null texts count as empty for every decision and stay null until they
are encoded; an empty table passes through; further columns stay as they are, but for those named like one
that the last stage adds, which give way to it. Null ids and repeated rows are documents like any other.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm import bpe, decontam, pseudonyms, simhash, toxicity
from velum.llm.linear import remainder
from velum.llm.queries import KEY, TOKENIZERS, VOCABULARY, table
from velum.llm.tokens import unused
from velum.session import materialize

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the threshold; learnt from the labels outside the held-out part."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("__key", 4) != 2)
    return docs.filter(toxicity.score("text", model) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: fingerprints of four-word shingles that differ in at most four bits."""
    return simhash.one_of_each(docs, words=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window of ten words with the benchmark."""
    found = unused("found", docs)
    scanned = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), out=found)
    return scanned.filter(F.col(found)["n_hit"] == 0).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms for personal numbers and dates; ``n_chars`` follows the text."""
    out = docs.withColumn("text", pseudonyms.pseudonymised("text", KEY)["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their tokens, and the digest of the text that the tokens decode to."""
    vocabulary = bpe.read_vocabulary(spark, os.path.join(TOKENIZERS, VOCABULARY))
    made = unused("tokens", docs)
    both = docs.withColumn(made, bpe.round_trip("text", vocabulary))
    added = {
        "n_tokens": (F.length(f"{made}.ids") / 4).cast("long"),
        "ids_sha256": F.sha2(f"{made}.ids", 256),
        "decoded_sha256": F.sha2(f"{made}.decoded", 256),
        "token_ids": F.col(f"{made}.ids"),
    }
    kept = [c for c in docs.columns if c.lower() not in added]
    return both.select(*kept, *[value.alias(name) for name, value in added.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

#: Learnt weights, fingerprints and merges are beyond SQL; the tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs.select("doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")
