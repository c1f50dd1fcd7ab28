"""Offsets of regex matches as an array column, without leaving the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.functions.patterns import Pattern
from velum.functions.validators import VALIDATORS, swedish_id

DETECTION = "struct<pii_type:string,entity_type:string,start:int,end:int,value:string,confidence:double>"
DETECTIONS = f"array<{DETECTION}>"

_REGEX_SIGNS = set("[](){}\\+*?.^$|")


def no_detections() -> Column:
    return F.array().cast(DETECTIONS)


def gate(text: Column, pattern: Pattern) -> Column:
    """Cheap necessary condition of a pattern; plain strings become a byte search."""
    if pattern.gate is None:
        return F.lit(True)
    if set(pattern.gate) & _REGEX_SIGNS:
        return text.rlike(pattern.gate)
    return text.contains(pattern.gate)


#: Put around hits. U+FFFF is no character; a text that holds it anyway is searched with U+FFFE in its place.
MARK, OTHER_MARK = "\uffff", "\ufffe"


def unmarked(text: Column) -> Column:
    """A text without ``MARK``."""
    return F.when(text.contains(MARK), F.translate(text, MARK, OTHER_MARK)).otherwise(text)


def parts(text: Column, pattern: Pattern) -> Column:
    """A text without ``MARK`` in pieces: in even places what precedes each match, in odd ones the match.

    The expression runs once: it puts marks around its matches, and the text is cut at the marks.
    """
    return F.split(F.regexp_replace(text, pattern.java_regex, f"{MARK}$0{MARK}"), MARK, -1)


#: Characters in a piece of a text.
PIECE = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima and the like of an array of integers.

    In round k every element takes in the one ``2**k`` places before, so n elements take log2(n) rounds
    over short numbers. (A fold that appends to an array copies it at every step.)
    """
    rounds = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int")

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, combine(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0))), numbers, step)


def _rounds(n: Column) -> Column:
    """0, 1, … for as many doublings as reach ``n``."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int") - 1)


def below(ordered: Column, limits: Column) -> Column:
    """For each limit, how many numbers of an ascending array are smaller: a binary search of all limits at once."""

    def search(at: Column, limit: Column) -> Column:
        def step(done: Column, k: Column) -> Column:
            to = done + F.call_function("shiftleft", F.lit(1), k)
            return F.when(F.get(ordered, to - 1) < limit, to).otherwise(done)

        return F.aggregate(F.reverse(at), F.lit(0), step)

    return let(_rounds(F.size(ordered)), lambda at: F.transform(limits, lambda x: search(at, x)))


def chain(following: Column) -> Column:
    """Numbers of the elements on the way from the first one, where each element leads to the one its entry names (a later
    one, or past the end).

    In round k the way known so far, of ``2**k`` elements, is put behind itself, every element moved on ``2**k`` places.
    Arrays are copied log2(n) times, not n times.
    """
    def way(follow: Column) -> Column:
        size = F.size(follow)

        def step(state: Column, _: Column) -> Column:
            jumps = state["jump"]
            further = F.filter(F.transform(state["way"], lambda i: F.get(jumps, i)), lambda i: i < size)
            return F.struct(F.transform(jumps, lambda i: F.coalesce(F.get(jumps, i), i)).alias("jump"), F.concat(state["way"], further).alias("way"))

        start = F.struct(follow.alias("jump"), F.array(F.lit(0)).alias("way"))
        return F.aggregate(_rounds(size), start, step, lambda state: state["way"])

    return let(following, way)


def pieces(text: Column) -> Column:
    """A text cut into pieces of ``PIECE`` characters, from which ``cut`` takes parts without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts_: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` (exclusive) of a text given as its pieces."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor(end / PIECE).cast("int")
    joined = F.array_join(F.slice(parts_, first + 1, last - first + 1), "")
    return F.substring(joined, start - first * PIECE + 1, end - start)


def _located(recogniser: Column) -> Column:
    """Detections of one recogniser: running sums over the lengths of the pieces give every end."""
    found = recogniser["parts"]
    ends = running(F.transform(found, F.length), lambda a, b: a + b)

    def located(part: Column, end: Column) -> Column:
        return F.struct(
            recogniser["meta"]["pii_type"].alias("pii_type"),
            recogniser["meta"]["entity_type"].alias("entity_type"),
            (end - F.length(part)).alias("start"),
            end.alias("end"),
            part.alias("value"),
            recogniser["meta"]["confidence"].alias("confidence"),
        )

    return F.filter(F.zip_with(found, ends, located), lambda _, i: i % 2 == 1)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _meta(patterns: Sequence[Pattern]) -> Column:
    """The constant part of every pattern as one literal array."""
    rows = (
        f"named_struct('pii_type', {_sql_text(p.pii_type)}, 'entity_type', {_sql_text(p.entity)},"
        f" 'confidence', {p.confidence}D)"
        for p in patterns
    )
    return F.expr(f"array({', '.join(rows)})")


def _validated(found: Column, patterns: Sequence[Pattern], pivot_year: int | None) -> Column:
    def passes(d: Column) -> Column:
        ok = F.lit(True)
        for p in patterns:
            if p.validator:
                check = (
                    swedish_id(d["value"], pivot_year)
                    if p.validator == "swedish_id"
                    else VALIDATORS[p.validator](d["value"])
                )
                ok = F.when(d["entity_type"] == p.entity, check).otherwise(ok)
        return ok

    return F.filter(found, passes)


def _boosted(text: Column, found: Column, patterns: Sequence[Pattern]) -> Column:
    def boosted(parts_: Column) -> Column:
        def one(d: Column) -> Column:
            def confidence(near: Column) -> Column:
                out = d["confidence"]
                for p in patterns:
                    if p.keywords:
                        out = F.when(d["entity_type"] == p.entity, _raised(d["confidence"], near, p.keywords)).otherwise(out)
                return out

            return d.withField("confidence", let(_near(parts_, d), confidence))

        return F.transform(found, one)

    return F.when(F.size(found) > 0, let(pieces(text), boosted)).otherwise(found)


def _near(parts_: Column, d: Column, width: int = 100) -> Column:
    return F.lower(window(parts_, d["start"], d["end"], width))


def _raised(confidence: Column, near: Column, keywords: Sequence[str]) -> Column:
    hit = near.rlike("|".join(re.escape(word) for word in keywords))
    return F.when(hit, F.least(F.lit(0.95), F.round(confidence + 0.10, 2))).otherwise(confidence)


def window(parts_: Column, start: Column, end: Column, width: int) -> Column:
    """The text, given as its pieces, from ``width`` characters before ``start`` to ``width`` after ``end``."""
    return cut(parts_, F.greatest(start - width, F.lit(0)), end + width)


def with_contexts(text: Column, found: Column, width: int = 50) -> Column:
    """Detections with the text around each as a further field ``context``."""

    def around(parts_: Column) -> Column:
        return F.transform(
            found, lambda d: F.struct(d.alias("hit"), F.translate(window(parts_, d["start"], d["end"], width), "\n", " ").alias("context")))

    # Texts without hits are not cut.
    return let(F.when(F.size(found) > 0, pieces(text)), around)


def detections(
    text: Column,
    patterns: Sequence[Pattern],
    *,
    validate: bool = False,
    pivot_year: int | None = None,
    gates: dict[str, Column] | None = None,
    only_if: dict[str, Column] | None = None,
) -> Column:
    """``array<struct>`` of every hit of every pattern, in catalogue order.

    ``gates`` may carry gate results computed beforehand, keyed by the gate expression;
    ``only_if`` restricts patterns, keyed by entity, to texts for which a condition holds.
    """
    if not patterns:
        return no_detections()
    bare = unmarked(text)
    tried = []
    for p in patterns:
        open_ = text.rlike(p.java_regex)  # texts without a match are not cut
        if p.gate is not None:
            open_ = (gates[p.gate] if gates else gate(text, p)) & open_
        if only_if and p.entity in only_if:
            open_ = only_if[p.entity] & open_
        tried.append(F.when(open_, parts(bare, p)))
    recognisers = F.arrays_zip(_meta(patterns).alias("meta"), F.array(*tried).alias("parts"))
    # A single piece is a text without a match.
    found = F.flatten(F.transform(F.filter(recognisers, lambda r: F.size(r["parts"]) > 1), _located))
    if validate:
        found = let(_validated(found, patterns, pivot_year), lambda valid: _boosted(text, valid, patterns))
    return found


def matches_of(text: Column, pattern: Pattern) -> Column:
    """Hits of a single pattern: the building block of detector plug-ins."""
    return detections(text, (pattern,))
