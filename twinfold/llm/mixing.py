"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and ``max_copies`` that give every source its
target number of words, those closest to equal rates in (bounded) entropy have
the form ``max_copies * sigmoid(lambda_source * size / mean size)``.  The convex
dual in lambda is solved by Newton steps; a step is one distributed sum over
(source, size) counts, and lambda stays in a table of one row per source.
Rates become whole copies by systematic rounding over the sizes of a source,
and the few words left over are mended one document at a time.

Targets: sources in code-point order, null last, take ``weights`` in turn and
share ``share`` times all words; a target above ``max_copies`` times its source
is cut to it and the excess is reshared by weight.

Nulls: a null text has size 0; a null source is a source of its own.  Documents
of size 0 take no words.  Repeated rows count as often as they stand there.  An
empty table gives an empty result.  Which of several documents of one size get
the extra copy is decided by a hash of the id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.operators.ranking import with_row_index
from twinfold.sources.lineage import cut_lineage, stored

_STEPS = 60  # at most; a step halves the bracket of lambda where Newton's step leaves it
_MENDS = 4
_SLICE = 1_000  # documents ranked in one group


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _targets(cells: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``__key, source_size, target``."""
    totals = cells.groupBy("__key").agg(F.first("__source").alias("__source"), F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                        F.sum("n").alias("docs"))
    ranked = with_row_index(totals, [F.col("__source").asc_nulls_last()])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__index") % len(weights) + 1).cast("int"))
    state = cut_lineage(ranked.select("__key", "source_size", "docs", weight.alias("weight"), F.lit(False).alias("capped")))
    while True:
        sums = state.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("capped"), F.col("source_size"))).alias("full"),
                         F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open")).first()
        level = (share * (sums["all"] or 0) - most * (sums["full"] or 0)) / sums["open"] if sums["open"] else 0.0
        over = ~F.col("capped") & (F.col("weight") * level > most * F.col("source_size"))
        if state.filter(over).isEmpty():
            break
        state = cut_lineage(state.withColumn("capped", F.col("capped") | over))
    target = F.when(F.col("capped"), most * F.col("source_size")).otherwise(F.col("weight") * level)
    return state.select("__key", "source_size", "docs", target.alias("target"))


def _rate(most: float) -> Column:
    tilt = F.when(F.col("full"), most).when(F.col("target") <= 0, 0.0).otherwise(
        most / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("scale"))))
    return F.when(F.col("size") > 0, tilt).otherwise(1.0)


def _solve(cells: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``__key, source_size, target, scale, lam, full``: the dual solution of each source."""
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = cut_lineage(targets.withColumn("scale", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)))
                        .withColumn("full", full).withColumn("lam", F.lit(0.0)).withColumn("low", F.lit(-1e6)).withColumn("high", F.lit(1e6))
                        .withColumn("done", full | (F.col("target") <= 0)))
    for _ in range(_STEPS):
        todo = state.filter(~F.col("done"))
        if todo.isEmpty():
            break
        words = F.col("n") * F.col("size")
        slope = F.col("rate") * (1 - F.col("rate") / most) * F.col("size") / F.col("scale")
        sums = (cells.join(todo, "__key").withColumn("rate", _rate(most)).groupBy("__key")
                .agg(F.sum(words * F.col("rate")).alias("taken"), F.sum(words * slope).alias("slope")))
        gap = F.col("taken") - F.col("target")
        near = F.abs(gap) <= 1e-6 * F.col("target")
        moved = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (moved > F.col("low")) & (moved < F.col("high"))
        state = cut_lineage(
            state.join(sums, "__key", "left")
            .withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low")))
            .withColumn("high", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
            .withColumn("lam", F.when(F.col("done") | near, F.col("lam")).when(inside, moved)
                        .otherwise((F.col("low") + F.col("high")) / 2))
            .withColumn("done", F.col("done") | near).drop("taken", "slope"))
    # sums of doubles depend on their order in the last digits; the rates must not
    return state.withColumn("lam", F.round("lam", 6)).drop("low", "high", "done", "docs")


def _rounded(cells: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """``cells`` with ``copies``, the whole number of copies that the documents of a cell take together.

    The window runs over the distinct sizes of a source, not over its documents.
    """
    up_to = Window.partitionBy("__key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    due = cells.join(solved, "__key").withColumn("rate", _rate(float(most))).withColumn("due", F.sum(F.col("n") * F.col("rate")).over(up_to))
    edge = F.floor(F.col("due") + 0.5)
    before = F.coalesce(F.lag(edge).over(Window.partitionBy("__key").orderBy("size")), F.lit(0))
    out = cut_lineage(due.withColumn("copies", F.least(F.greatest(edge - before, F.lit(0)), most * F.col("n"))).drop("due"))
    # what one huge document leaves open is filled (or taken away) from the largest documents that fit
    left = stored(out.groupBy("__key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left")), "left")
    larger = Window.partitionBy("__key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.when(F.col("left") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    room = F.when((F.col("size") > 0) & (F.col("size") <= F.abs("left")), room).otherwise(0)
    rest = F.abs("left") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
    moved = F.least(F.col("room"), F.floor(F.greatest(rest, F.lit(0.0)) / F.greatest("size", F.lit(1))))
    out = (out.join(left, "__key").withColumn("room", room).withColumn("moved", moved)
           .withColumn("copies", F.col("copies") + F.signum("left").cast("bigint") * F.col("moved")).drop("left", "room", "moved"))
    out = cut_lineage(out)
    for _ in range(_MENDS):
        left = out.groupBy("__key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        # one document more or less of the size that comes nearest to what is left
        fits = F.when(F.col("left") > 0, F.col("copies") < most * F.col("n")).otherwise(F.col("copies") > 0)
        better = fits & (F.col("size") > 0) & (F.abs(F.abs("left") - F.col("size")) < F.abs("left"))
        moves = (out.join(left, "__key").filter(better).groupBy("__key")
                 .agg(F.min(F.struct(F.abs(F.abs("left") - F.col("size")).alias("d"), F.col("size").alias("size"),
                                     F.signum("left").cast("bigint").alias("by"))).alias("m"))
                 .select("__key", F.col("m.size").alias("size"), F.col("m.by").alias("by")))
        moves = stored(moves, "moves")
        if moves.isEmpty():
            break
        out = cut_lineage(out.join(moves, ["__key", "size"], "left")
                          .withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by"))
    return out


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: int = 2,
            id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``<id>, source, size, source_size, target, rate, copies, taken`` for each row."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("null"))
    sized = stored(docs.select(id_column, F.col(source_column).alias("__source"), key.alias("__key"),
                               word_count(F.col(text_column)).alias("size")), "sizes")
    cells = stored(sized.groupBy("__key", "size").agg(F.first("__source").alias("__source"), F.count(F.lit(1)).alias("n")), "cells")
    solved = _solve(cells, _targets(cells, weights, share, float(max_copies)), float(max_copies))
    taken = _rounded(cells, solved, max_copies).drop("__source")
    taken = (taken.withColumn("each", F.floor(F.col("copies") / F.col("n"))).withColumn("rest", F.col("copies") % F.col("n"))
             .withColumn("slices", F.ceil(F.col("n") / _SLICE)).drop("copies"))
    placed = sized.join(stored(taken, "taken"), ["__key", "size"])
    some, even = placed.filter("rest > 0"), placed.filter("rest = 0").withColumn("copies", F.col("each"))
    order = F.xxhash64(id_column)
    some = some.withColumn("__h", order).withColumn("__slice", F.pmod(F.col("__h"), F.col("slices")))
    cell = ["__key", "size", "__slice"]
    before = Window.partitionBy("__key", "size").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = some.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("__h", id_column)) + F.col("__before")
    some = some.join(offsets, cell).withColumn("copies", F.col("each") + F.when(rank <= F.col("rest"), 1).otherwise(0))
    out = [id_column, F.col("__source").alias("source"), "size", "source_size", "target", "rate", "copies",
           (F.col("copies") * F.col("size")).alias("taken")]
    return even.select(*out).unionByName(some.select(*out))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: int = 2,
          id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it.

    Rows repeated under one id share the copies of that id evenly where they can:
    each row is taken as often as the first of them.
    """
    copies = (mixture(docs, weights, share, max_copies, id_column, text_column, source_column)
              .groupBy(F.col(id_column).alias("__id")).agg(F.max("copies").alias("__copies")).filter("__copies > 0"))
    repeated = docs.join(stored(copies, "copies"), docs[id_column].eqNullSafe(F.col("__id")))
    return repeated.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
