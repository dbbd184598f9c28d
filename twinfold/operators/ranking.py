"""Global running totals without gathering the rows anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.sources.lineage import cut_lineage

_WITHIN = (1 << 33) - 1  # low bits of monotonically_increasing_id: position in the partition


def with_position(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """``__part`` and ``__pos`` of each row, in ``order_by`` or scan order.

    The rows are checkpointed so that the partitions counted later are exactly
    the ones numbered here.
    """
    df = df.orderBy(*order_by) if order_by else df
    placed = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    return (placed.withColumn("__part", F.shiftright("__id", 33))
            .withColumn("__pos", F.col("__id").bitwiseAND(F.lit(_WITHIN))).drop("__id"))


def part_offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """``__part, __offset``: the total weight of all earlier partitions (one row per partition)."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.groupBy("__part").agg(F.sum(weight).alias("__total"))
            .select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")))


def with_row_index(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """``__index``: 0, 1, 2, … over the whole frame."""
    placed = with_position(df, order_by)
    return (placed.join(part_offsets(placed, F.lit(1)), "__part")
            .withColumn("__index", F.col("__offset") + F.col("__pos")).drop("__part", "__pos", "__offset"))


def with_running_total(df: DataFrame, order_by: Sequence[str | Column], weight: str) -> DataFrame:
    """``__before``: the summed weight of all rows that sort earlier.  The order must be unique."""
    placed = with_position(df, order_by)
    earlier = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    return (placed.join(part_offsets(placed, F.col(weight)), "__part")
            .withColumn("__before", F.col("__offset") + inside).drop("__part", "__pos", "__offset"))
