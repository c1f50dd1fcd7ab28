"""Findings enriched by a caller's model: prompts, distinct calls, cache, merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions import grading
from velum.functions.text import parse_reply
from velum.session import materialize

CLASSIFY_REPLY = "confidence double, sensitivity string"
ARTICLES_REPLY = "violations array<struct<article:string>>, reasoning string"
ADVICE_REPLY = "recommended_strategy string, implementation string"

Predict = Callable[[list[str]], list[str]]


def classify_prompt() -> Column:
    """Our own wording. The detected value is never part of a prompt, only its context."""
    return F.concat(
        F.lit("Classify the hidden value.\nDetected type: "), F.col("pii_type"),
        F.lit("\nValue: [REDACTED]\nContext: "), F.col("context"),
        F.lit("\nReply as JSON with confidence (0 to 1) and sensitivity (critical, high, medium, low)."),
    )


def articles_prompt() -> Column:
    return F.concat(
        F.lit("Which articles does keeping this data touch?\nType: "), F.col("pii_type"),
        F.lit("\nSeverity: "), F.col("severity"), F.lit("\nLocation: "), F.col("location"),
        F.lit("\nReply as JSON with violations (list of {article}) and reasoning."),
    )


def advice_prompt() -> Column:
    return F.concat(
        F.lit("How should this value be anonymised?\nType: "), F.col("pii_type"),
        F.lit("\nSensitivity: "), F.col("severity"), F.lit("\nContext: "), F.col("context"),
        F.lit("\nReply as JSON with recommended_strategy and implementation."),
    )


def prompt_key(prompt: Column, parameters: str = "") -> Column:
    """Cache key: digest of the prompt and the call parameters."""
    return F.sha2(F.concat_ws("\n", F.lit(parameters), prompt), 256)


def answer(prompts: DataFrame, predict: Predict, *, batch: int = 64) -> DataFrame:
    """``(key, reply)`` for ``(key, prompt)`` rows. A batch that fails gives empty replies, not a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                try:
                    replies = predict(part["prompt"].tolist())
                except Exception:
                    replies = [""] * len(part)
                yield pd.DataFrame({"key": part["key"], "reply": replies})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, reply string")


def cached_answers(prompts: DataFrame, predict: Predict, cache_path: str | None = None, *, slots: int | None = None) -> DataFrame:
    """Replies for distinct prompts; those in the Parquet cache are not asked again.

    New replies are appended to the cache and read back, so a failure later on does not
    repeat the calls. ``slots`` limits how many tasks call the model at the same time.
    """
    # One row per key: the prompt is combined before the shuffle, however often it occurs.
    distinct = prompts.groupBy("key").agg(F.any_value("prompt").alias("prompt"))
    if cache_path is None:
        return materialize(answer(distinct.repartition(slots, "key") if slots else distinct, predict), "replies")
    spark = prompts.sparkSession
    schema = "key string, reply string"
    try:
        known = spark.read.schema(schema).parquet(cache_path)
        missing = distinct.join(known, "key", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = distinct
    asked = answer(missing.repartition(slots, "key") if slots else missing, predict)
    asked.filter(F.col("reply") != "").write.mode("append").parquet(cache_path)
    stored = spark.read.schema(schema).parquet(cache_path).join(distinct.select("key"), "key", "left_semi")
    return stored.groupBy("key").agg(F.any_value("reply").alias("reply"))


def _with_replies(findings: DataFrame, prompt: Column, schema: str, name: str, predict: Predict,
                  cache_path: str | None) -> DataFrame:
    """Findings with the parsed reply to their prompt. ``findings`` are read twice: for the prompts, and for the join."""
    keyed = findings.withColumn("__prompt", prompt).withColumn("__key", prompt_key(F.col("__prompt"), name))
    asked = keyed.select(F.col("__key").alias("key"), F.col("__prompt").alias("prompt"))
    replies = cached_answers(asked, predict, f"{cache_path}/{name}" if cache_path else None)
    parsed = replies.select(F.col("key").alias("__key"), parse_reply(F.col("reply"), schema).alias(name))
    return keyed.join(parsed, "__key", "left").drop("__key", "__prompt")


def enrich(findings: DataFrame, predict: Predict, cache_path: str | None = None) -> DataFrame:
    """Ask three questions per finding and merge what comes back.

    Confidence only rises; severity is replaced by a known level; articles and reasoning
    are replaced when the reply has articles; advice is appended. Without a usable reply
    a finding stays as it was. The second and third question need the first reply only, so findings are written once, before
    the first; what the replies change is computed anew from there.
    """
    out = _with_replies(materialize(findings, "to-enrich"), classify_prompt(), CLASSIFY_REPLY, "classify", predict, cache_path)
    level = F.lower(F.col("classify.sensitivity"))
    sure = F.col("classify.confidence")
    out = out.withColumns(
        {
            "confidence": F.when(sure.between(0, 1), F.greatest("confidence", sure)).otherwise(F.col("confidence")),
            "severity": F.when(level.isin(*grading.SEVERITY_ORDER), level).otherwise(F.col("severity")),
        }
    ).drop("classify")
    out = _with_replies(out, articles_prompt(), ARTICLES_REPLY, "articles", predict, cache_path)
    out = _with_replies(out, advice_prompt(), ADVICE_REPLY, "advice", predict, cache_path)
    named = F.filter(F.transform("articles.violations", lambda v: v["article"]), lambda a: a.isNotNull())
    how = F.col("advice.implementation")
    appended = F.concat(F.col("recommendation"), F.lit("\n\nSuggested approach: "), how)
    return out.withColumns(
        {
            "gdpr_articles": F.when(F.size(named) > 0, named).otherwise(F.col("gdpr_articles")),
            "gdpr_reasoning": F.coalesce("articles.reasoning", "gdpr_reasoning"),
            "anonymization_strategy": F.coalesce("advice.recommended_strategy", "anonymization_strategy"),
            "recommendation": F.when(how != "", appended).otherwise(F.col("recommendation")),
        }
    ).drop("articles", "advice")
