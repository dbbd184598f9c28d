"""Audit of filter interactions by sorted posting lists.

Every row gets a number; for each part and filter the numbers of the failing
rows form a sorted list, cut into ranges of at most ``RANGE`` numbers so that a
part of any size is many short lists.  One galloping merge of the lists of a
range gives the sizes of their disjoint differences: the rows that are in just
these lists and in none of the others.  A list leaps over all its numbers before
the next head of another list at once.  These sizes are summed per part, and
every union, difference and order of filters is a sum of them.

Nulls: a null text is empty; a null or empty part is the part ``''``; a null id
fails no comparison with other ids and has no label.  Rows repeated under one id
are rows of their own with the labels of that id; equal texts under one id do
not make each other a repetition, for neither id is smaller.  Labels repeated
for an id count once.  An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.sources.lineage import stored

RANGE_BITS = 14  # numbers of a range: 2^14
_WITHIN = (1 << 33) - 1  # low bits of monotonically_increasing_id: place in the partition


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text; it must not be null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def leap(numbers: Sequence[int], start: int, target: int) -> int:
    """The first place from ``start`` whose number is ``target`` or more: doubled steps, then halving inside the last one."""
    step, low = 1, start
    while low + step < len(numbers) and numbers[low + step] < target:
        low, step = low + step, 2 * step
    return bisect_left(numbers, target, low, min(low + step + 1, len(numbers)))


def difference_sizes(lists: Sequence[Sequence[int]]) -> dict[int, int]:
    """``{lists as bits: how many numbers are in just these}`` of sorted lists without repetitions."""
    sizes: dict[int, int] = {}
    at = [0] * len(lists)
    heads = {k: x[0] for k, x in enumerate(lists) if len(x)}
    while heads:
        least = min(heads.values())
        here = [k for k, x in heads.items() if x == least]
        mask = sum(1 << k for k in here)
        if len(here) == 1:
            others = [x for x in heads.values() if x > least]
            k = here[0]
            to = leap(lists[k], at[k], min(others)) if others else len(lists[k])
            sizes[mask] = sizes.get(mask, 0) + to - at[k]
            at[k] = to
        else:
            sizes[mask] = sizes.get(mask, 0) + 1
            for k in here:
                at[k] += 1
        for k in here:
            if at[k] < len(lists[k]):
                heads[k] = lists[k][at[k]]
            else:
                del heads[k]
    return sizes


def part_differences(posts: DataFrame, n_lists: int) -> DataFrame:
    """``part, mask, n`` from ``part, list int, row bigint``: sizes of the disjoint differences of the lists of a part."""
    ranged = posts.groupBy("part", F.shiftright("row", RANGE_BITS).alias("range"))
    lists = ranged.agg(*(F.array_sort(F.collect_list(F.when(F.col("list") == k, F.col("row")))).alias(f"list_{k}") for k in range(n_lists)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], int] = {}
            columns = [batch.column(f"list_{k}") for k in range(n_lists)]
            for i, part in enumerate(batch.column("part").to_pylist()):
                for mask, n in difference_sizes([c[i].values.to_numpy().tolist() for c in columns]).items():
                    sums[part, mask] = sums.get((part, mask), 0) + n
            parts, masks = zip(*sums) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(masks, pa.int32()), pa.array(sums.values(), pa.int64())],
                                             ["part", "mask", "n"])

    found = lists.drop("range").mapInArrow(merged, "part string, mask int, n long")
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row for each part, order of the filters A-E and step.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    failures = text_failures(F.col("text"))
    rows = (docs.select(F.col(id_column).alias("id"), text.alias("text"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"))
            .select("id", "part", F.sha2("text", 256).alias("digest"), F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(failures.values()))).alias("lists"),
                    F.monotonically_increasing_id().alias("row")))
    rows = stored(rows, "audited")

    first = (rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter(F.col("first") != F.col("last"))
             .select("digest", "first"))
    letters = [*failures, "E"]
    names = [*letters, "good", "toxic"]
    by_text = rows.select("part", F.explode(F.array_compact("lists")).alias("list"), "row")
    copies = rows.join(first, "digest").filter(F.col("id") > F.col("first")).select("part", F.lit(letters.index("E")).alias("list"), "row")
    marks = [labels.filter(F.col(c) == 1).select(F.col(id_column).alias("id"), F.lit(names.index(kind)).alias("list"))
             for c, kind in (("quality", "good"), ("toxic", "toxic"))]
    marked = rows.select("part", "id", "row").join(marks[0].union(marks[1]).distinct(), "id").select("part", "list", "row")
    sizes = part_differences(by_text.union(copies).union(marked), len(names))
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    per_part = (totals.join(sizes, "part", "left").groupBy("part", "rows")
                .agg(F.collect_list(F.when(F.col("mask").isNotNull(), F.struct("mask", "n"))).alias("sizes")))
    return in_orders(per_part, letters)


def order_sums(letters: Sequence[str]) -> tuple[list[tuple[str, int]], np.ndarray, list[str]]:
    """The (order, step) rows, and for each row and column which differences (by their bits) its value sums."""
    masks = np.arange(1 << (len(letters) + 2))
    good, toxic = (masks >> len(letters)) & 1 > 0, (masks >> (len(letters) + 1)) & 1 > 0
    failing = masks & ((1 << len(letters)) - 1)
    keys, sums = [], []
    for order in permutations(range(len(letters))):
        earlier = 0
        for step, k in enumerate(order, 1):
            fails, removed = failing >> k & 1 > 0, (failing >> k & 1 > 0) & (failing & earlier == 0)
            keys.append(("".join(letters[i] for i in order), step))
            earlier |= 1 << k
            sums.append([failing & earlier > 0, removed, fails & ~removed, failing == 1 << k, removed & good, removed & toxic])
    # a filter's removals summed over all orders, at whatever step
    table = np.array(sums, np.int64)
    last = np.array([letters.index(order[step - 1]) for order, step in keys])
    total = np.stack([table[last == k, 1].sum(0) for k in range(len(letters))])
    return keys, np.concatenate([table, total[last][:, None]], 1), ["gone", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def in_orders(per_part: DataFrame, letters: Sequence[str]) -> DataFrame:
    """The rows of :func:`audit` from ``part, rows, sizes array<struct<mask, n>>``: sums of a few sizes for each part."""
    keys, table, names = order_sums(letters)
    columns = ["kept", *names[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, sizes in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "sizes"))):
                n = np.zeros(table.shape[2], np.int64)
                for x in sizes:
                    n[x["mask"]] += x["n"]
                values = table @ n
                values[:, 0] = rows - values[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.string()), pa.array([o for o, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32()),
                     *(pa.array(values[:, j]) for j in range(len(columns)))], ["part", "filter_order", "step", *columns])

    return per_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY t) AS first FROM t
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
d AS (
  SELECT part, w.doc_id, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': w.doc_id > first} AS f,
    good.doc_id IS NOT NULL AS is_good, toxic.doc_id IS NOT NULL AS is_toxic
  FROM w LEFT JOIN good ON good.doc_id = w.doc_id LEFT JOIN toxic ON toxic.doc_id = w.doc_id
), fails AS (
  SELECT part, doc_id, is_good, is_toxic, (CASE WHEN f['A'] THEN 'A' ELSE '' END) || (CASE WHEN f['B'] THEN 'B' ELSE '' END)
    || (CASE WHEN f['C'] THEN 'C' ELSE '' END) || (CASE WHEN f['D'] THEN 'D' ELSE '' END) || (CASE WHEN f['E'] THEN 'E' ELSE '' END) AS s FROM d
), cells AS (
  SELECT part, s, count(*) AS n, count(*) FILTER (is_good) AS good, count(*) FILTER (is_toxic) AS toxic FROM fails GROUP BY part, s
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT o, step, o[step] AS x, o[1:step - 1] AS earlier, o[1:step] AS upto FROM orders, unnest([1, 2, 3, 4, 5]) AS u(step)),
sums AS (
  SELECT part, o, step, x,
    sum(n) FILTER (s = translate(s, upto, '')) AS kept, sum(n) FILTER (contains(s, x) AND s = translate(s, earlier, '')) AS removed,
    sum(n) FILTER (contains(s, x) AND s <> translate(s, earlier, '')) AS redundant, sum(n) FILTER (s = x) AS unique_fails,
    sum(good) FILTER (contains(s, x) AND s = translate(s, earlier, '')) AS good_lost,
    sum(toxic) FILTER (contains(s, x) AND s = translate(s, earlier, '')) AS toxic_lost
  FROM cells, steps GROUP BY part, o, step, x
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM sums
"""
