"""Mixing sources to target weights by entropy balancing. DataFrame and SQL functions only.

Sources have weights, and a target number of words each: their share of all words, at most ``most`` times what they
have; what is cut off goes to the others by weight. Within a source every document gets a rate. Of all rates that give
the source its target, the balanced ones stay closest to one copy of each document (least relative entropy,
rates between 0 and ``most``): ``min(most, exp(lambda * size))``, one multiplier a source. The multipliers
solve the convex dual, by Newton steps for all sources at once: a step is one aggregate over the numbers of documents of
each source and size (rates depend on nothing else, so this table, not the corpus, is what the steps read). A step
that would leave the interval known to hold the solution goes to its middle. Rates are kept in billionths of a copy
and summed exactly, so a rerun gives the same rows in whatever order tasks finish.

Rates become copies in two steps. Numbers of copies of each source and size are differences of the rounded running
sum of the rates by size, so a source misses its target by no more than about its longest document; then single copies
are moved where this brings the source nearer. The copies of a size are dealt evenly over its documents, the odd ones by
the order of a hash of key and text.

A null source is a source of its own, behind the others. Null, empty and blank texts have no words, get no words
and keep a row; repeated rows are documents of their own; among equal rows it does not matter which one gets a copy. A source
without words has target 0. An empty table gives an empty result. Columns of any name do no harm: only those asked for by
``keep`` are carried along, and a column of theirs named like a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.operators.tables import number_rows
from velum.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: Parts of a copy in which rates are kept.
UNIT = 1_000_000_000
#: Newton steps and moves of single copies at most; both end when nothing is left to do.
STEPS, MOVES = 100, 8
#: Least relative distance of a source's words from its target that the steps go on for.
CLOSE = 1e-7

_SOURCE = ["__none", "__name"]
_BIG = "decimal(38,0)"
RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Sources ``(__none, __name, __all)`` with ``__target``.

    Weights go round by rank. Who would get over ``most`` times its size stops there, and the rest is shared anew,
    until nobody is above; each round is an aggregate of two numbers.
    """
    place = F.struct(*_SOURCE)
    ranked = number_rows(sources.withColumn("__place", place), "__place").drop("__place")
    number = (F.pmod(F.col("row_number") - 1, F.lit(len(weights))) + 1).cast("int")
    ranked = materialize(ranked.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), number)).drop("row_number"), "sources")
    cap = F.col("__all") * most
    words = ranked.agg(F.sum("__all")).first()[0] or 0
    share = 0.0
    while True:
        full = cap <= F.col("__weight") * F.lit(share)
        rest, weight = ranked.agg(F.lit(words) - F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(~full, F.col("__weight")))).first()
        if not weight or rest / weight <= share:
            break
        share = rest / weight
    wish = F.col("__weight") * F.lit(share)
    return ranked.withColumn("__target", F.when(cap <= wish, cap.cast("double")).otherwise(wish))


def _rate(most: int) -> Column:
    """Rate of a size under its source's multiplier, in parts of a copy."""
    open_ = F.floor(F.least(F.exp(F.col("__lambda") * F.col("__size") / F.col("__mean")), F.lit(float(most))) * UNIT)
    return (
        F.when(F.col("__target") >= F.col("__all") * most, F.lit(most * UNIT))
        .when(F.col("__target") <= 0, F.lit(0))
        .otherwise(open_)
        .cast("long")
    )


def multipliers(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``__lambda`` for every source, from ``(__none, __name, __size, __n)`` and the targets.

    ``__low`` and ``__high`` hold the solution: at the upper end even the smallest document is at the bound (or unchanged),
    at the lower end even the smallest is cut as much as the whole.
    """
    some = sizes.filter(F.col("__size") > 0)
    shape = some.groupBy(*_SOURCE).agg(
        F.min("__size").alias("__least"), (F.sum(F.col("__size") * F.col("__n")) / F.sum("__n")).alias("__mean"),
        F.sum(F.col("__size").cast("double") ** 2 * F.col("__n")).alias("__squares"))
    least, more = F.col("__least") / F.col("__mean"), F.col("__target") > F.col("__all")
    solved = (F.col("__target") >= F.col("__all") * most) | (F.col("__target") == F.col("__all")) | (F.col("__target") <= 0)
    state = (
        sources.join(shape, _SOURCE)
        .withColumn("__low", F.when(solved | more, F.lit(0.0)).otherwise(F.log(F.col("__target") / F.col("__all")) / least))
        .withColumn("__high", F.when(solved | ~more, F.lit(0.0)).otherwise(F.log(F.lit(float(most))) / least))
        .withColumn("__lambda", (F.col("__target") - F.col("__all")) * F.col("__mean") / F.col("__squares"))
        .withColumn("__lambda", F.when(solved, F.lit(0.0)).otherwise(F.greatest("__low", F.least("__high", "__lambda"))))
        .select(*_SOURCE, "__all", "__target", "__mean", "__low", "__high", "__lambda", solved.alias("__done"))
    )
    state = materialize(state, "multipliers")
    for _ in range(STEPS):
        if state.filter(~F.col("__done")).isEmpty():
            break
        rate = _rate(most)
        words = F.col("__size") * F.col("__n")
        slope = F.when(rate < most * UNIT, words.cast(_BIG) * F.floor(rate * F.col("__size") / F.col("__mean")).cast(_BIG)).otherwise(0)
        sums = (
            some.join(state.filter(~F.col("__done")), _SOURCE)
            .groupBy(*_SOURCE)
            .agg((F.sum(words.cast(_BIG) * rate.cast(_BIG)).cast("double") / UNIT).alias("__got"),
                 (F.sum(slope).cast("double") / UNIT).alias("__slope"))
        )
        over = F.col("__got") - F.col("__target")
        low, high = F.when(over < 0, F.col("__lambda")).otherwise(F.col("__low")), F.when(over > 0, F.col("__lambda")).otherwise(F.col("__high"))
        step = F.col("__lambda") - over / F.when(F.col("__slope") > 0, F.col("__slope"))
        inside = (step > low) & (step < high)
        # Rates have few billionths at the ends of a narrow interval: its middle is then as good as any.
        done = (F.abs(over) <= F.col("__target") * CLOSE) | ((high - low) <= F.abs(high) * 1e-15)
        next_ = F.when(done, F.col("__lambda")).when(inside, step).otherwise((low + high) / 2)
        moved = state.join(sums, _SOURCE, "left").select(
            *_SOURCE, "__all", "__target", "__mean",
            *[F.when(F.col("__done"), F.col(c)).otherwise(v).alias(c) for c, v in (("__low", low), ("__high", high), ("__lambda", next_))],
            (F.col("__done") | done).alias("__done"))
        state = materialize(moved, "multipliers")
    return state


def _copies(sizes: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """Sizes with ``__rate`` and the number of copies, ``__copies``, that all documents of a size get together."""
    rated = sizes.join(state, _SOURCE, "left").withColumn("__rate", F.when(F.col("__size") > 0, _rate(most)).otherwise(0))
    rated = rated.withColumn("__share", F.coalesce(F.col("__rate"), F.lit(0)).cast(_BIG) * F.col("__n").cast(_BIG))
    # A source has one row a size, so this window is bounded by the different lengths of texts.
    so_far = F.sum("__share").over(Window.partitionBy(*_SOURCE).orderBy("__size").rowsBetween(Window.unboundedPreceding, 0))

    def rounded(x: Column) -> Column:
        return F.floor((x + UNIT // 2) / UNIT).cast("long")

    made = rated.withColumn("__to", so_far.cast(_BIG)).withColumn("__copies", rounded(F.col("__to")) - rounded(F.col("__to") - F.col("__share")))
    # Rounding may push a size over its bound by one; what it loses here, the moves bring back.
    bounded = F.greatest(F.lit(0), F.least(F.col("__copies"), F.col("__n") * most))
    columns = [*_SOURCE, "__size", "__n", "__rate", "__target"]
    made = materialize(made.select(*columns, bounded.alias("__copies")), "copies")
    for _ in range(MOVES):
        missing = made.groupBy(*_SOURCE).agg(
            (F.round(F.max("__target")).cast("long") - F.sum(F.col("__copies") * F.col("__size"))).alias("__missing"))
        missing = missing.filter(F.col("__missing") != 0)
        way = F.signum(F.col("__missing")).cast("long")
        able = F.when(way > 0, F.col("__copies") < F.col("__n") * most).otherwise(F.col("__copies") > 0) & (F.col("__size") > 0)
        after = F.abs(F.col("__missing") - way * F.col("__size"))
        moves = (
            made.join(missing, _SOURCE).filter(able & (after < F.abs("__missing")))
            .groupBy(*_SOURCE).agg(F.min(F.struct(after.alias("after"), F.col("__size").alias("size"), way.alias("way"))).alias("__move"))
        )
        moves = materialize(moves.select(*_SOURCE, F.col("__move.size").alias("__size"), F.col("__move.way").alias("__way")), "moves")
        if moves.isEmpty():
            break
        made = made.join(moves, [*_SOURCE, "__size"], "left").select(*columns, (F.col("__copies") + F.coalesce("__way", F.lit(0))).alias("__copies"))
        made = materialize(made, "copies")
    return made


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ("doc_id",),
        weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``keep`` columns of every row with its ``size`` in words, the ``source_size`` and ``target`` of its source, the
    balanced ``rate``, the ``copies`` the mix takes of it, and the words ``taken`` with them.

    Weights go round over the sources by code point, null last.
    """
    keep = [c for c in keep if c not in RESULTS]
    narrow = docs.select(
        F.struct(*keep).alias("__keep") if keep else F.lit(None).cast("string").alias("__keep"),
        F.col(source).isNull().alias("__none"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__name"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("__size"),
        F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("__order"),
        F.monotonically_increasing_id().alias("__tie"),
    )
    narrow = materialize(narrow, "sizes")
    # Ranges of source, size and hash; equal rows are told apart by their place, so no range holds many of them.
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_SOURCE, "__size", "__order", "__tie"]
    cut = materialize(narrow.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    cells = materialize(cut.groupBy("__range", *_SOURCE, "__size").agg(F.count("*").alias("__m")), "cells")
    sizes = materialize(cells.groupBy(*_SOURCE, "__size").agg(F.sum("__m").alias("__n")), "sizes")
    sources = sizes.groupBy(*_SOURCE).agg(F.sum(F.col("__size") * F.col("__n")).alias("__all"))
    sources = targets(sources, weights, most)
    made = _copies(sizes, multipliers(sizes, sources, most), most)
    # The place of a document among those of its size: of all ranges before, and in its own.
    group = [*_SOURCE, "__size"]
    before = F.sum("__m").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("__range", *group, F.coalesce(before, F.lit(0)).alias("__before"))
    cells = cells.join(made.drop("__target"), group).join(sources.select(*_SOURCE, "__all", "__target"), _SOURCE)
    inside = F.row_number().over(Window.partitionBy("__range", *group).orderBy("__order", "__tie")) - 1
    placed = cut.withColumn("__inside", inside).join(materialize(cells, "cells"), ["__range", *group])
    odd = (F.col("__inside") + F.col("__before")) < F.col("__copies") % F.col("__n")
    copies = (F.floor(F.col("__copies") / F.col("__n")) + odd.cast("long")).cast("long")
    return placed.select(
        *[F.col("__keep")[c].alias(c) for c in keep],
        F.col("__size").alias("size"),
        F.col("__all").cast("long").alias("source_size"),
        F.col("__target").alias("target"),
        (F.coalesce(F.col("__rate"), F.lit(0)) / UNIT).alias("rate"),
        copies.alias("copies"),
        (copies * F.col("__size")).alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it has copies, numbered by ``copy`` from 1."""
    return mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
