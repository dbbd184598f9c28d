"""Similarity self-join of text values, and its result as blocking keys.

Two texts are *near* by one of the pair similarities: an item ratio above the
list threshold, or an affine gap distance of at most ``cutoff``.  Both bound
what may differ, which gives a complete set of candidates without comparing all
values:

* Pairs of texts of at most ``SHORT`` letters share a text that both turn into by
  leaving out a few letters; each posts all of these.
* By affine gap distance, in pairs with a longer text both have at least ``LONG`` letters
  and share a number of letter pairs, so they share one among the rarest ones of either.
* By item ratio that number is too small to tell texts apart that have parts in common.
  There the longer texts meet in cells of two pieces of lengths that fit, each pair in
  one cell; a cell compares the letters of its texts first, as bit vectors.

Distinct values only are joined; what is left is compared exactly.  A near pair is
a key of both of its values, and every value is a key of itself: two records agree
nearly on a field exactly if they share one of these keys, so near agreement is
joined like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions import similarity as sim
from twinfold.functions.blockkeys import near_column
from twinfold.functions.similarity import close_items
from twinfold.sources.lineage import stored

SHORT, LONG = 12, 10
#: Texts of a piece in the cells of the item ratio.
PIECE = 4_096
#: Beyond this affine gap distance two texts need not share any pair of letters.
MOST = 2.0


@dataclass(frozen=True)
class Nearness:
    """``cutoff``: the largest affine gap distance; None: the ratio of list items."""

    cutoff: float | None = None

    def __post_init__(self):
        if self.cutoff is not None and not sim.MATCH / 2 <= self.cutoff <= MOST:
            raise ValueError(f"no complete candidates for a cutoff of {self.cutoff}: {sim.MATCH / 2} to {MOST}")

    def left_out(self, mine: int, other: int) -> int:
        """How many of ``mine`` letters may have no equal partner in a near text of ``other`` letters; -1 if none is near."""
        both = mine + other
        if self.cutoff is None:
            common = sim.LIST_SIMILARITY_THRESHOLD * both // 200 + 1
            return mine - common if common <= min(mine, other) else -1
        spare = (self.cutoff - sim.MATCH / 2) * both + 1e-9
        gap = sim.GAP_EXTEND - sim.MATCH / 2  # a letter in a gap in place of half a match
        most = -1
        for g in range(mine + 1):
            h = other - mine + g  # letters of the other text in a gap
            if h >= 0:
                left = spare - sum(sim.GAP_OPEN + gap * n for n in (g, h) if n)
                if left >= 0:
                    most = max(most, g + min(int(left // (sim.MISMATCH - sim.MATCH)), mine - g))
        return most

    def deletions(self) -> list[int]:
        """By length from 0 to ``SHORT``: letters to leave out to meet every near text of these lengths."""
        return [max([0, *(self.left_out(a, b) for b in range(SHORT + 1))]) for a in range(SHORT + 1)]

    def prefix(self, length: str) -> str:
        """SQL: how many of its rarest letter pairs a text posts for an affine gap distance."""
        return f"cast(floor({2 * (self.cutoff - sim.MATCH / 2) / 5} * {length} + 1e-9) as int) + 1"

    def lengths_fit(self, short: str, long: str) -> str:
        if self.cutoff is None:
            r = sim.LIST_SIMILARITY_THRESHOLD / 200
            return f"{1 - r} * {short} > {r} * {long} - 1e-9"
        gap = sim.GAP_EXTEND - sim.MATCH / 2
        return f"({short} = {long} or {sim.GAP_OPEN} + {gap} * ({long} - {short}) <= {self.cutoff - sim.MATCH / 2} * ({short} + {long}) + 1e-9)"

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that are near."""
        if self.cutoff is not None:
            return pairs.filter(sim.affine_gap()(F.col("a"), F.col("b")) <= self.cutoff + 1e-9)
        # a common subsequence leaves out at least as many letters as the edit distance counts
        most = f"cast(floor((length(a) + length(b)) * {100 - sim.LIST_SIMILARITY_THRESHOLD} / 100) as int)"
        return pairs.filter(F.expr(f"levenshtein(a, b, {most}) >= 0")).filter(sim.ratio(F.col("a"), F.col("b")) > sim.LIST_SIMILARITY_THRESHOLD)


def _shortened(values: DataFrame, nearness: Nearness) -> DataFrame:
    """``value, key``: what the short texts turn into by leaving out letters."""
    by_length = nearness.deletions()
    limit = f"element_at(array({', '.join(map(str, by_length))}), length(value) + 1)"
    step = ("array_distinct(flatten(transform(x, v -> if(length(v) = 0, cast(array() as array<string>), "
            "transform(sequence(1, length(v)), i -> concat(substring(v, 1, i - 1), substring(v, i + 1)))))))")
    level, every = "array(value)", ["array(value)"]
    for k in range(1, max(by_length) + 1):
        level = f"transform(array({level}), x -> {step})[0]"
        every.append(f"if({k} <= {limit}, {level}, cast(array() as array<string>))")
    return values.filter(F.length("value") <= SHORT).selectExpr("value", f"explode(array_distinct(flatten(array({', '.join(every)})))) as key")


def _rare_pairs(values: DataFrame, nearness: Nearness) -> DataFrame:
    """``value, n, key``: the rarest letter pairs of the longer texts."""
    long = values.filter(F.length("value") >= LONG)
    pairs = "transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))"
    numbered = f"transform({pairs}, (g, i) -> struct(g as g, size(filter(slice({pairs}, 1, i), h -> h = g)) as nth))"
    grams = stored(long.selectExpr("value", f"explode({numbered}) as key"), "letter-pairs")
    counts = grams.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    ordered = (grams.join(counts, "key").groupBy("value")
               .agg(F.array_sort(F.collect_list(F.struct("texts", "key"))).alias("keys")).withColumn("n", F.length("value")))
    return (ordered.select("value", "n", F.explode(F.slice("keys", 1, F.expr(nearness.prefix("n")))).alias("k"))
            .select("value", "n", F.col("k.key").alias("key")))


def _by_rare_pairs(values: DataFrame, nearness: Nearness) -> DataFrame:
    """``a, b``: pairs with a text above ``SHORT`` letters that share one of their rarest letter pairs."""
    rare = stored(_rare_pairs(values, nearness), "rare-pairs")
    low = rare.select(F.col("value").alias("u"), F.col("n").alias("m"), "key")
    high = rare.select(F.col("value").alias("v"), "n", "key")
    # a pair of equal lengths has its smaller text as the shorter one
    met = low.join(high, "key").filter(f"(m < n or m = n and u < v) and n > {SHORT} and {nearness.lengths_fit('m', 'n')}")
    return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _close_in_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: the near pairs of a cell; one that a piece makes with itself has its texts on the first side only."""
    sides, same = ([], []), False
    for batch in batches:
        rows = batch.to_pydict()
        same = rows["same"][0]
        for side, value in zip(rows["side"], rows["value"]):
            sides[side].append(value)
    left, right = sides[0], sides[0] if same else sides[1]
    texts = [pa.array(x, pa.string()) for x in (left, right)]
    for i, j in close_items(left, right, same, SHORT):
        yield pa.RecordBatch.from_arrays([texts[0].take(pa.array(i)), texts[1].take(pa.array(j))], ["a", "b"])


def _by_cells(values: DataFrame, nearness: Nearness) -> DataFrame:
    """``a, b``: the pairs with a text above ``SHORT`` letters whose item ratio is above the threshold."""
    spark = values.sparkSession
    # bands of a tenth more letters each
    banded = values.selectExpr("value", "length(value) as n", "cast(floor(ln(length(value)) / ln(1.1)) as int) as band")
    bands = stored(banded.groupBy("band").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("parts")),
                   "bands")
    pieces = banded.join(bands, "band").selectExpr("value", "band", "cast(pmod(xxhash64(value), parts) as int) as piece")
    each = {x: bands.selectExpr(f"band as {x}", f"low as low_{x}", f"high as high_{x}", f"explode(sequence(0, parts - 1)) as piece_{x}") for x in "uv"}
    cells = stored(each["u"].join(each["v"], F.expr(f"(u < v and {nearness.lengths_fit('high_u', 'low_v')} or u = v and piece_u <= piece_v) and high_v > {SHORT}"))
                   .selectExpr("u", "piece_u", "v", "piece_v", "u = v and piece_u = piece_v as same"), "cells")
    cell = ["u", "piece_u", "v", "piece_v"]
    sides = (cells.selectExpr("u as band", "piece_u as piece", "0 as side", "*")
             .union(cells.filter("not same").selectExpr("v as band", "piece_v as piece", "1 as side", "*")))
    # a cell has few bytes and many pairs: the number of partitions is not left to the bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = pieces.join(sides, ["band", "piece"]).select(*cell, "same", "side", "value").repartition(parts, *cell)
    return met.groupBy(*cell).applyInArrow(_close_in_cell, "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_pairs(values: DataFrame, nearness: Nearness) -> DataFrame:
    """``a, b`` (a < b): all near pairs of different texts in the column ``value``, each once.  Null and empty texts are near none."""
    values = stored(values.select("value").filter("value <> ''").distinct(), "values")
    keys = stored(_shortened(values, nearness), "shortened")
    left, right = (keys.select(F.col("value").alias(x), "key") for x in "ab")
    short = left.join(right, "key").filter("a < b").select("a", "b")
    if nearness.cutoff is None:
        return nearness.confirmed(short.distinct()).union(_by_cells(values, nearness))
    return nearness.confirmed(short.union(_by_rare_pairs(values, nearness)).distinct())


def near_keys(pairs: DataFrame) -> DataFrame:
    """``value, keys array<string>``: the keys of the values that have near ones."""
    key = F.concat("a", F.lit("\x1e"), "b")
    sides = pairs.select(F.col("a").alias("value"), key.alias("key")).union(pairs.select(F.col("b").alias("value"), key.alias("key")))
    return sides.groupBy("value").agg(F.collect_list("key").alias("keys"))


def field_values(records: DataFrame, field: str) -> DataFrame:
    """``value``: the texts or list items of a field."""
    is_list = isinstance(records.schema[field].dataType, T.ArrayType)
    return records.select((F.explode(field) if is_list else F.col(field)).alias("value"))


def with_near_keys(records: DataFrame, pairs: Mapping[str, DataFrame], id_column: str = "record_id") -> DataFrame:
    """``records`` with the column that the predicate ``near`` reads, for each field of ``pairs`` (its near pairs)."""
    none = F.expr("cast(array() as array<string>)")
    for field, near in pairs.items():
        is_list = isinstance(records.schema[field].dataType, T.ArrayType)
        own = F.filter(field, lambda x: x != "") if is_list else F.when(F.col(field) != "", F.array(field))
        table = stored(near_keys(near), "near-keys")
        posted = records.select(id_column, (F.explode(field) if is_list else F.col(field)).alias("value")).join(table, "value")
        more = posted.groupBy(id_column).agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("__more"))
        records = (records.join(stored(more, "near-records"), id_column, "left")
                   .withColumn(near_column(field), F.concat(F.coalesce(own, none), F.coalesce("__more", none))).drop("__more"))
    return records
