"""Anonymisation of texts, findings, columns, and the value map behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions import masking
from velum.functions.spans import cut, let, pieces
from velum.operators.detect import resolve_overlaps


def _replacement(d: Column, strategy: str, overrides: Mapping[str, str] | None, key: Column | None) -> Column:
    return masking.replacement(d["value"], d["pii_type"], strategy, overrides, key)


#: From so many different values on it is worth to look whether they can be replaced at once.
MANY = 16


def text_by_value(
    text: Column, found: Column, strategy: str = "mask", overrides: Mapping[str, str] | None = None, key: Column | None = None,
    *, placed: bool = False,
) -> Column:
    """Replace every occurrence of each hit's value, in the order of the hits.

    Empty values are skipped. A value that occurs many times is replaced once, as the
    first replacement already reaches all of its occurrences. Of hits that are ``placed``, with ``start`` and ``end``, many
    values are replaced in one pass if that gives the same text (see ``_at_once``), else one after another.
    """
    def with_new(d: Column) -> Column:
        at = [d["start"].alias("start"), d["end"].alias("end")] if placed else []
        return F.struct(*at, d["value"].alias("value"), _replacement(d, strategy, overrides, key).alias("new"))

    hits = F.transform(F.filter(found, lambda d: d["value"] != ""), with_new)

    def replaced(all_: Column) -> Column:
        pairs = F.array_distinct(F.transform(all_, lambda d: F.struct(d["value"].alias("value"), d["new"].alias("new"))))

        def of(p: Column) -> Column:
            one_by_one = F.aggregate(p, text, lambda acc, x: F.replace(acc, x["value"], x["new"]))
            return one_by_one if not placed else F.coalesce(F.when(F.size(p) > MANY, let(F.array_sort(all_), lambda h: _at_once(text, h, p))), one_by_one)

        return let(pairs, of)

    return let(hits, replaced)


def _at_once(text: Column, hits: Column, pairs: Column) -> Column:
    """The text with all hits replaced at their places, if one replacement after another would give just that; else null.

    That is so if at no time a value stands anywhere but at its own hits. Hits must not overlap, a value must have one
    replacement, and none may begin another one. Then an occurrence elsewhere, in the text as it is while some
    values are replaced and others are not, would begin with the first ``q`` characters of a value at a place that is no hit.
    No value or replacement is shorter than ``q``, so such a piece meets at most two neighbouring hits: it shows in
    one of four texts, with no hit replaced, all, the odd or the even ones. These are searched for all pieces at once.
    """
    return let(F.array_sort(F.transform(pairs, lambda p: p["value"])), lambda values: _if_independent(text, hits, pairs, values))


def _if_independent(text: Column, hits: Column, pairs: Column, ordered: Column) -> Column:
    apart = F.forall(F.transform(hits, lambda h, i: h["start"] >= F.coalesce(F.get(hits, i - 1)["end"], F.lit(0))), lambda x: x)
    begins = F.exists(F.transform(ordered, lambda v, i: F.coalesce(F.get(ordered, i + 1).startswith(v), F.lit(False))), lambda x: x)
    shortest = F.array_min(F.transform(pairs, lambda p: F.least(F.length(p["value"]), F.length(p["new"]))))
    simple = apart & ~begins & (shortest >= 3) & (F.size(F.array_distinct(ordered)) == F.size(pairs))

    def segments(parts: Column) -> Column:
        return F.transform(hits, lambda h, i: F.struct(
            cut(parts, F.coalesce(F.get(hits, i - 1)["end"], F.lit(0)), h["start"]).alias("gap"), h["value"].alias("value"), h["new"].alias("new")))

    def checked(q: Column) -> Column:
        starts = F.array_distinct(F.transform(ordered, lambda v: F.left(v, q)))
        every = F.concat(F.lit("(?s)(?=(.{"), q.cast("string"), F.lit("}))."))

        def of(parts: Column) -> Column:
            tail = cut(parts, F.element_at(hits, -1)["end"], F.length(text))
            return let(segments(parts), lambda all_: let(tail, lambda rest: chosen(all_, rest)))

        def chosen(all_: Column, rest: Column) -> Column:
            def body(new) -> Column:
                return F.concat(F.array_join(F.transform(all_, lambda s, i: F.concat(s["gap"], F.when(new(i), s["new"]).otherwise(s["value"]))), ""), rest)

            def astray(new) -> Column:
                """Whether a value may begin at a place that is no hit."""
                def marked(s: Column, i: Column) -> Column:
                    hit = F.when(new(i), F.array_repeat(F.lit(0), F.length(s["new"]))).otherwise(
                        F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.length(s["value"]) - 1)))
                    return F.concat(F.array_repeat(F.lit(0), F.length(s["gap"])), hit)

                places = F.flatten(F.transform(all_, marked))
                pieces_ = F.regexp_extract_all(body(new), every, F.lit(1))
                others = let(places, lambda at: F.filter(pieces_, lambda _, i: F.coalesce(F.get(at, i), F.lit(0)) == 0))
                return F.arrays_overlap(others, starts)

            states = [lambda i: F.lit(False), lambda i: F.lit(True), lambda i: i % 2 == 0, lambda i: i % 2 == 1]
            safe = body(states[0]) == text  # every value stands at its place
            for state in states:
                safe = safe & ~astray(state)
            return F.when(safe, body(states[1]))

        return let(pieces(text), of)

    return F.when(F.coalesce(simple, F.lit(False)), let(F.least(F.lit(6), shortest), checked))


def text_by_span(
    text: Column, found: Column, strategy: str = "mask", overrides: Mapping[str, str] | None = None, key: Column | None = None
) -> Column:
    """Replace the hits at their positions; where hits overlap, ``resolve_overlaps`` decides."""

    def replaced(kept: Column, parts: Column) -> Column:
        def one(d: Column, i: Column) -> Column:
            before = F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
            return F.concat(cut(parts, before, d["start"]), _replacement(d, strategy, overrides, key))

        last = F.element_at(kept, -1)["end"]
        return F.concat(F.array_join(F.transform(kept, one), ""), cut(parts, last, F.length(text)))

    def of(kept: Column) -> Column:
        return F.when(F.size(kept) == 0, text).otherwise(let(pieces(text), lambda parts: replaced(kept, parts)))

    return let(resolve_overlaps(found), of)


def attach_findings(docs: DataFrame, findings: DataFrame, doc_key: str, finding_key: str) -> DataFrame:
    """Bring findings from a table of their own back to their documents as an array of hits.

    Findings of one document are bounded by its text; repeated values are dropped
    before the shuffle.
    """
    hits = findings.groupBy(F.col(finding_key).alias(doc_key), "pii_type", F.col("content").alias("value")).agg(
        F.min("seq").alias("seq")
    )
    per_doc = hits.groupBy(doc_key).agg(
        F.array_sort(F.collect_list(F.struct("seq", "pii_type", "value"))).alias("detections")
    )
    none = F.array().cast(per_doc.schema["detections"].dataType)
    return docs.join(per_doc, doc_key, "left").withColumn("detections", F.coalesce("detections", none))


def anonymize_findings(
    findings: DataFrame, strategy: str = "mask", overrides: Mapping[str, str] | None = None, key: Column | None = None
) -> DataFrame:
    """A new scan ``<id>_anonymized`` with replaced contents; ``key`` is for the strategy ``encrypt``."""
    return findings.withColumns(
        {
            "content": masking.replacement(F.col("content"), F.col("pii_type"), strategy, overrides, key),
            "scan_id": F.concat(F.col("scan_id"), F.lit("_anonymized")),
        }
    )


def anonymize_columns(df: DataFrame, columns: Sequence[str], strategy: str = "mask") -> DataFrame:
    """Replace named columns; the type comes from the column name, null, empty and zero stay.

    The strategy is the requested one for every column: the per-type preference is not used here.
    """
    known = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    changes = {}
    for name in columns:
        if name not in known:
            continue
        value = F.col(name)
        text = value.cast("string")
        kind = masking.type_from_field_name(F.lit(name))
        keep = value.isNull() | (text == "")
        if known[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or known[name].startswith("decimal"):
            keep = keep | (value == 0)
        elif known[name] == "boolean":
            keep = keep | ~value
        changes[name] = F.when(keep, text).otherwise(masking.apply_strategy(text, kind, F.lit(strategy)))
    return df.withColumns(changes) if changes else df


def replacement_map(
    findings: DataFrame, order: Column, strategy: str = "mask", overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Value to replacement; a value found under several types follows its last finding."""
    last = findings.groupBy("content").agg(F.max_by("pii_type", order).alias("pii_type"))
    return last.select(
        F.col("content").alias("value"),
        masking.replacement(F.col("content"), F.col("pii_type"), strategy, overrides).alias("replacement"),
    )


def strategy_matrix(findings: DataFrame) -> DataFrame:
    """Every strategy applied to every distinct value."""
    values = findings.select("pii_type", "content").distinct()
    kind, value = F.col("pii_type"), F.col("content")
    return values.select(
        "pii_type",
        "content",
        masking.strategy_for(kind, "mask").alias("preferred"),
        *[masking.apply_strategy(value, kind, F.lit(s)).alias(f"as_{s}") for s in masking.STRATEGIES],
    )
