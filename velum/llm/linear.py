"""What the classifiers share: a bounded sample of labelled texts and scoring with a weight vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(docs: DataFrame, labels: DataFrame, train: Column, *, key: str, text: str, label: str, rows: int) -> DataFrame:
    """Up to ``rows`` labelled texts as ``(__order, __label, __text)``, the same ones in every run.

    Ids are drawn from the labels alone, by the order of a hash, so at most ``rows`` of them are
    broadcast and only their texts leave the scan. Rows with a null id or label take no part; an id that
    is labelled twice counts once, with its greatest label.
    """
    chosen = (
        labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
        .filter(F.col("__key").isNotNull() & F.col("__label").isNotNull())
        .groupBy("__key")
        .agg(F.max("__label").alias("__label"))
        .filter(train)
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(rows)
    )
    texts = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return (
        texts.join(F.broadcast(chosen), "__key")
        .groupBy("__key")  # an id that stands in several rows counts once
        .agg(F.min("__text").alias("__text"), F.first("__label").alias("__label"))
        .select(F.xxhash64("__key").alias("__order"), "__label", "__text")
    )


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def held_out(key: str, modulus: int, value: int) -> Column:
    """Whether the remainder of a key is ``value``. A row without a key is neither held out nor learnt from."""
    return F.coalesce(remainder(key, modulus) == value, F.lit(False)).alias("held_out")
