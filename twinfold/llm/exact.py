"""Exact deduplication by a two-pass Bloom filter (DataFrame functions only).

Pass 1 counts the filter positions of all text hashes and keeps, as bits, those
that were hit twice or more.  Pass 2 looks every row up in these bits.  A row
with a clear bit has no equal text and passes straight through; only the
others are grouped by their full hash.  False positives of the filter cost a
shuffled row and never change the result.

The filter takes about ``bits_per_row`` bits a row and at most ``max_bits``
(16 MB by default): that bounds what is sent to the executors.  Beyond
``max_bits / bits_per_row`` rows it gets denser and more rows are grouped.

Nulls: a null text equals the empty text; a null id is the smallest.  Repeated
rows with one id count as copies; one of them stays.  An empty table gives an
empty result.  Extra columns are carried along by :func:`drop_copies`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.sources.lineage import stored

_SEEDS = (17, 71)  # one filter position for each


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _positions(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(s)), F.lit(bits)) for s in _SEEDS]


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    """A power of two, 1,024 at least."""
    return min(max_bits, max(1024, 2 ** math.ceil(math.log2(max(1, rows) * bits_per_row))))


def repeated_filter(digests: DataFrame, bits: int, digest: str = "__digest") -> DataFrame:
    """One row ``filter array<bigint>``: the bits of the positions that were hit more than once."""
    hits = (digests.select(F.explode(F.array(*_positions(F.col(digest), bits))).alias("p"))
            .groupBy("p").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1"))
    words = (hits.groupBy(F.shiftright("p", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("value")))
    every = digests.sparkSession.range(bits // 64).select(F.col("id").alias("word"))
    dense = every.join(words, "word", "left").select("word", F.coalesce("value", F.lit(0)).alias("value"))
    packed = F.array_sort(F.collect_list(F.struct("word", "value")))
    return dense.agg(F.transform(packed, lambda x: x["value"]).alias("filter"))


def possibly_repeated(digest: Column, bits_table: DataFrame, bits: int) -> Column:
    table = bits_table.scalar()
    tests = [F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
             for p in _positions(digest, bits)]
    return tests[0] & tests[1]


def copy_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                bits_per_row: int = 16, max_bits: int = 1 << 27) -> DataFrame:
    """``<id>, keep_id, group_size, kept, text_sha256`` for each row; of equal texts the largest id stays.

    Rows repeated under one id are all marked as kept: the table has no way to tell them apart.
    """
    hashed = stored(docs.select(id_column, text_digest(F.col(text_column)).alias("text_sha256")), "digests")
    bits = filter_bits(hashed.count(), bits_per_row, max_bits)
    table = stored(repeated_filter(hashed, bits, "text_sha256"), "bloom")
    maybe = possibly_repeated(F.col("text_sha256"), table, bits)
    some, alone = hashed.filter(maybe), hashed.filter(~maybe)
    groups = stored(some.groupBy("text_sha256").agg(F.max(id_column).alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
                    "copy-groups")
    passed = alone.select(id_column, F.col(id_column).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                          "text_sha256")
    grouped = some.join(groups, "text_sha256").select(id_column, "keep_id", "group_size", "text_sha256")
    return (passed.unionByName(grouped)
            .withColumn("kept", F.col(id_column).eqNullSafe(F.col("keep_id"))))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                bits_per_row: int = 16, max_bits: int = 1 << 27) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Equal texts are combined before the shuffle: a hot text sends one row a task.
    """
    hashed = docs.withColumn("__digest", text_digest(F.col(text_column)))
    narrow = stored(hashed.select("__digest"), "digests")
    bits = filter_bits(narrow.count(), bits_per_row, max_bits)
    table = stored(repeated_filter(narrow, bits), "bloom")
    maybe = possibly_repeated(F.col("__digest"), table, bits)
    row = F.struct(F.col(id_column).alias("__first"), F.struct(*docs.columns).alias("__row"))
    best = hashed.filter(maybe).groupBy("__digest").agg(F.max(row).alias("__best"))
    return (hashed.filter(~maybe).select(*docs.columns)
            .unionByName(best.select("__best.__row.*").select(*docs.columns)))
