"""Detection: a text column in, one row per hit out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import spans
from velum.functions.patterns import BASE, CUSTOM, DIGIT, DOCUMENT, ENTITY_TO_TYPE, TOPICS, VALIDATED, Pattern, Topic
from velum.functions.patterns import for_language
from velum.session import spread


def with_detections(
    df: DataFrame,
    text: str,
    patterns: Sequence[Pattern] = DOCUMENT,
    *,
    out: str = "detections",
    validate: bool = False,
    pivot_year: int | None = None,
    only_if: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the array of hits to each row. Narrow: no shuffle, no Python worker.
    """
    gated, names = with_gates(df, text, patterns)
    t = F.col(text)
    found = spans.detections(
        t, patterns, validate=validate, pivot_year=pivot_year, gates={g: F.col(n) for g, n in names.items()},
        only_if=only_if,
    )
    blank = F.trim(F.coalesce(t, F.lit(""))) == ""
    return gated.select(*df.columns, F.when(blank, spans.no_detections()).otherwise(found).alias(out))


def with_gates(df: DataFrame, text: str, patterns: Sequence[Pattern]) -> tuple[DataFrame, dict[str, str]]:
    """Add the gates of the patterns as boolean columns; also returns gate expression to column name.

    Gates are columns of projections of their own, so that patterns sharing a gate
    (six digits in a row, say) look for it once per text. Gates that start with a
    digit are only tried on texts that have any.
    """
    owners = {p.gate: p for p in patterns if p.gate}
    names = {g: f"__gate{i}" for i, g in enumerate(owners)}
    t, has_digit = F.col(text), F.col("__digit")
    gated = df.select("*", t.rlike(DIGIT).alias("__digit")).select(
        "*",
        *[
            (has_digit & spans.gate(t, p) if g.startswith(DIGIT) else spans.gate(t, p)).alias(names[g])
            for g, p in owners.items()
        ],
    )
    return gated, names


def explode_detections(
    df: DataFrame,
    keep: Sequence[str],
    text: str | None = None,
    *,
    array: str = "detections",
    threshold: float = 0.5,
    context: int = 50,
) -> DataFrame:
    """One row per hit: ``keep``, ordinal ``seq`` within the text, the hit, and its context.

    The outer form of the generator is on purpose: for the inner one the optimizer
    derives ``size(array) > 0``, pushes it down and runs every regex a second time.
    """
    fields = ("pii_type", "entity_type", "start", "end", "value", "confidence")
    if text is None:
        rows = df.select(*keep, F.posexplode_outer(array).alias("seq", "d")).filter(F.col("d.confidence") >= threshold)
        return rows.select(*keep, "seq", *[F.col(f"d.{f}").alias(f) for f in fields])
    # Contexts are cut before the hits become rows, so no row carries the text.
    around = spans.let(F.col(array), lambda found: spans.with_contexts(F.col(text), found, context))
    rows = df.select(*keep, F.posexplode_outer(around).alias("seq", "d")).filter(F.col("d.hit.confidence") >= threshold)
    return rows.select(*keep, "seq", *[F.col(f"d.hit.{f}").alias(f) for f in fields], F.col("d.context").alias("context"))


def detect(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    patterns: Sequence[Pattern] = DOCUMENT,
    *,
    validate: bool = False,
    pivot_year: int | None = None,
    threshold: float = 0.5,
    context: int = 50,
    spread_input: bool = True,
) -> DataFrame:
    """Scan a text column. Only ``keep`` and ``text`` are read; ``text`` is dropped once contexts are cut.

    ``spread_input=False`` is for texts that were spread over the cores before.
    """
    source = df.select(*dict.fromkeys([*keep, text]))
    if spread_input:
        source = spread(source, *keep)
    found = with_detections(source, text, patterns, validate=validate, pivot_year=pivot_year)
    return explode_detections(found, keep, text, threshold=threshold, context=context)


def detect_validated(df: DataFrame, text: str, keep: Sequence[str], *, pivot_year: int | None = None) -> DataFrame:
    """EU and Nordic identifiers that pass their checks, raised near context words."""
    return detect(df, text, keep, VALIDATED, validate=True, pivot_year=pivot_year)


def detect_custom(df: DataFrame, text: str, keep: Sequence[str], patterns: Sequence[Pattern] = CUSTOM) -> DataFrame:
    """User-defined patterns; each hit carries the severity and articles of its pattern."""
    hits = detect(df, text, keep, patterns)
    sev, arts = None, None
    for p in patterns:
        test = F.col("entity_type") == p.entity
        names = F.array(*[F.lit(a) for a in p.articles]).cast("array<string>")
        sev = F.when(test, p.severity) if sev is None else sev.when(test, p.severity)
        arts = F.when(test, names) if arts is None else arts.when(test, names)
    return hits.withColumns({"severity": sev, "gdpr_articles": arts})


def detect_by_language(
    df: DataFrame, text: str, lang: str, keep: Sequence[str], languages: Sequence[str]
) -> DataFrame:
    """Each text is searched with the pattern set of its own language, in one pass over the input.

    Languages not listed get the general set. A pattern that not all sets share is only
    tried on texts in its languages.
    """
    source = spread(df.select(*dict.fromkeys([*keep, lang, text])), *keep)
    sets = {code: {p.entity for p in for_language(code)} for code in languages}
    general = {p.entity for p in for_language("")}
    only_if = {}
    for p in DOCUMENT:
        having = [code for code, names in sets.items() if p.entity in names]
        if p.entity not in general:
            only_if[p.entity] = F.coalesce(F.col(lang).isin(having), F.lit(False))
        elif len(having) < len(sets):
            lacking = [code for code in sets if code not in having]
            only_if[p.entity] = F.coalesce(~F.col(lang).isin(lacking), F.lit(True))
    found = with_detections(source, text, DOCUMENT, only_if=only_if)
    return explode_detections(found, [*dict.fromkeys([*keep, lang])], text)


def detect_topics(df: DataFrame, text: str, keep: Sequence[str], topics: Sequence[Topic] = TOPICS) -> DataFrame:
    """One row per text and sensitive subject whose keywords it contains."""
    low = F.col("__low")
    hits = []
    for t in topics:
        test = F.lit(False)
        for word in t.keywords:
            test = test | low.contains(word)
        row = F.struct(
            F.lit(t.name).alias("topic"),
            F.lit(t.severity).alias("severity"),
            F.lit(t.confidence).alias("confidence"),
            F.array(*[F.lit(a) for a in t.articles]).cast("array<string>").alias("gdpr_articles"),
        )
        hits.append(F.when(test, row))
    source = spread(df.select(*dict.fromkeys([*keep, text])), *keep)
    lowered = source.select(*keep, F.lower(F.col(text)).alias("__low"))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return lowered.select(*keep, F.inline_outer(found)).filter(F.col("topic").isNotNull())


Model = Callable[[list[str]], list[list[tuple[str, int, int, float]]]]


def detect_with_model(
    df: DataFrame, text: str, keep: Sequence[str], predict: Model, *, threshold: float = 0.5, batch: int = 256
) -> DataFrame:
    """Hits of a caller's model, which maps texts to ``(entity, start, end, score)`` lists.

    Texts stay where they are: the model runs on Arrow batches inside the tasks. For
    long texts lower ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    source = spread(df.select(*dict.fromkeys([*keep, text])), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema.fields)
    schema = f"{fields}, entity_type string, start int, end int, value string, confidence double"
    columns = [*keep, "entity_type", "start", "end", "value", "confidence"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame[text].fillna("").str.strip() != ""]
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                texts = part[text].tolist()
                rows = [
                    (*key, entity, start, end, body[start:end], score)
                    for key, body, hits in zip(part[list(keep)].itertuples(index=False), texts, predict(texts))
                    for entity, start, end, score in hits
                    if score >= threshold
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return source.mapInPandas(run, schema).withColumn("pii_type", entity_to_type(F.col("entity_type")))


def entity_to_type(entity: Column) -> Column:
    """Entity name to PII type; unknown names become OTHER."""
    out = None
    for name, pii_type in ENTITY_TO_TYPE.items():
        out = F.when(entity == name, pii_type) if out is None else out.when(entity == name, pii_type)
    return out.otherwise("OTHER")


def pattern_catalog(spark: SparkSession, patterns: Sequence[Pattern] = VALIDATED) -> DataFrame:
    """Supported entities with type, score and description: one row per pattern."""
    rows = [(p.entity, p.pii_type, p.confidence, p.description) for p in patterns]
    return spark.createDataFrame(rows, "entity_type string, pii_type string, confidence double, description string")


def resolve_overlaps(found: Column) -> Column:
    """Keep a set of hits that do not overlap: earliest start, then longest, then surest.

    Each hit knows the next one that is free of it; the kept ones are the chain from the first, which
    ``spans.chain`` follows in steps that double.
    """
    keyed = F.transform(
        found,
        lambda d: F.struct(
            d["start"].alias("a"), (-d["end"]).alias("b"), (-d["confidence"]).alias("c"),
            d["entity_type"].alias("e"), d.alias("hit"),
        ),
    )

    def kept(hits: Column) -> Column:
        starts = F.transform(hits, lambda k: k["a"])
        following = spans.let(starts, lambda s: F.transform(spans.below(s, F.transform(hits, lambda k: -k["b"])), lambda n, i: F.greatest(n, i + 1)))
        chosen = F.transform(spans.chain(following), lambda i: F.get(hits, i)["hit"])
        return F.when(F.size(hits) > 1, chosen).otherwise(F.transform(hits, lambda k: k["hit"]))

    return spans.let(F.array_sort(keyed), kept)


def text_sections(df: DataFrame, text: str, source: Column, section_id: Column) -> DataFrame:
    """Any text column as the ``sections`` shape the file readers produce."""
    return df.select(
        source.cast("string").alias("source"),
        section_id.cast("string").alias("section_id"),
        F.col(text).alias("text"),
        F.lit(None).cast("int").alias("page_number"),
        F.create_map().cast("map<string,string>").alias("meta"),
    )


__all__ = [
    "BASE", "with_detections", "explode_detections", "detect", "detect_validated", "detect_custom",
    "detect_by_language", "detect_topics", "detect_with_model", "entity_to_type", "resolve_overlaps",
    "text_sections",
]
