"""Profiling tables A1-A19: each is a DataFrame computed in one or two aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.text import MISSING_TOKENS, age_in_years, missing_like
from twinfold.operators.ranking import with_running_total

# Literals that are no value when distinct values are counted, and when
# empty cells are shared out by group.
NO_VALUE = ("", "NaN", "nan")
# Small-category and share limits of the reports.
VALUE_COUNT_THRESHOLD = 10
NULL_SHARE_THRESHOLD = 5.0
NULL_SHARE_REPORT_THRESHOLD = 2.0
REPORT_NULL_COLUMNS = ("sex", "social_security_number", "addresses_city", "telephones", "emails")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text; lists as their items joined."""
    c = _col(name)
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    return c.cast("string")


def per_column(df: DataFrame, out: str, make) -> DataFrame:
    """One aggregation over all columns, turned into ``Column_name, <out>`` rows."""
    wide = df.agg(F.array(*(F.struct(F.lit(c).alias("Column_name"), make(c).alias(out)) for c in df.columns)).alias("t"))
    return wide.select(F.inline("t"))


def count_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """A1: missing-like cells per column."""
    return per_column(df, "missing", lambda c: F.count_if(missing_like(as_text(df, c), tokens)))


def null_percentages(df: DataFrame, out: str = "Null_values", tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """A2: missing-like share per column in percent, 0 for an empty table."""
    share = lambda c: F.coalesce(100.0 * F.count_if(missing_like(as_text(df, c), tokens))
                                 / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    return per_column(df, out, share)


def raw_clean_join(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Statistics of the raw columns with those of the cleaned ones, on ``Column_name``."""
    return raw.join(clean, "Column_name", "left")


def null_table(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """A3 + O3: missing shares before and after cleaning, most missing first."""
    joined = raw_clean_join(null_percentages(raw, "Null_values_raw"), null_percentages(clean, "Null_values_clean"))
    return joined.orderBy(F.desc("Null_values_clean"), "Column_name")


def value_counts(df: DataFrame) -> DataFrame:
    """``Column_name, value, count``: every distinct value of every column, in one shuffle.

    Values are pre-aggregated per task, so a value that fills a third of the
    table costs one row per task.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("Column_name"), as_text(df, c).alias("value")) for c in df.columns))
    return df.select(F.inline(cells)).groupBy("Column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def unique_values(df: DataFrame, out: str = "Unique_values", approximate: bool = False) -> DataFrame:
    """A4 for one table: distinct values per column, NULL and no-value literals not counted."""
    real = lambda c: ~c.isin(*NO_VALUE)
    if approximate:
        return per_column(df, out, lambda c: F.approx_count_distinct(F.when(real(as_text(df, c)), as_text(df, c))))
    return (value_counts(df).groupBy("Column_name")
            .agg(F.count_if(F.coalesce(real(F.col("value")), F.lit(False))).alias(out)))


def unique_table(raw: DataFrame, clean: DataFrame, approximate: bool = False) -> DataFrame:
    """A4: distinct values before and after cleaning."""
    return raw_clean_join(unique_values(raw, "Unique_values_raw", approximate),
                          unique_values(clean, "Unique_values_clean", approximate))


def dtypes_table(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """A5: column types before and after cleaning (schema only, no data is read)."""
    spark, after = raw.sparkSession, dict(clean.dtypes)
    rows = [(c, t, after.get(c)) for c, t in raw.dtypes]
    return spark.createDataFrame(rows, "Column_name string, Data_types_raw string, Data_types_clean string")


def _bytes(df: DataFrame, out: str) -> DataFrame:
    return per_column(df, out, lambda c: F.coalesce(F.sum(F.octet_length(as_text(df, c))), F.lit(0)).cast("bigint"))


def size_table(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Bytes of cell text per column before and after cleaning."""
    return raw_clean_join(_bytes(raw, "Memory_bytes_raw"), _bytes(clean, "Memory_bytes_clean"))


def quantiles(counts: DataFrame, probabilities: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact interpolated quantiles per ``Column_name`` from ``(Column_name, number, count)``.

    The distinct values are range-sorted and numbered by running totals, so no
    task or driver ever holds a whole column.
    """
    ranked = with_running_total(counts, ["Column_name", "number"], "count")
    spans = ranked.groupBy("Column_name").agg(F.min("__before").alias("start"), F.sum("count").alias("n"))
    placed = ranked.join(spans, "Column_name")  # one row per column
    placed = placed.withColumn("first", F.col("__before") - F.col("start"))

    def at(rank: Column) -> Column:
        here = (F.col("first") <= rank) & (rank < F.col("first") + F.col("count"))
        return F.max(F.when(here, F.col("number")))

    results = []
    for p, name in zip(probabilities, names):
        rank = (F.col("n") - 1) * F.lit(float(p))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        results.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    return placed.groupBy("Column_name").agg(*results)


def describe(df: DataFrame) -> DataFrame:
    """One row per column: count, unique, top, freq for text; moments and quartiles for numbers."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    textual = [c for c in df.columns if c not in numeric]
    base = per_column(df, "count", lambda c: F.count(_col(c)))
    out = base
    if textual:
        seen = value_counts(df.select(*map(_col, textual))).filter(F.col("value").isNotNull())
        # most frequent value, the smallest one among equals
        tops = seen.groupBy("Column_name").agg(F.count(F.lit(1)).alias("unique"), F.max("count").alias("most"))
        best = (seen.join(tops, "Column_name").filter(F.col("count") == F.col("most"))
                .groupBy("Column_name").agg(F.max("unique").alias("unique"), F.min("value").alias("top"),
                                            F.max("count").alias("freq")))
        out = out.join(best, "Column_name", "left")
    else:
        out = out.select("*", F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
                         F.lit(None).cast("bigint").alias("freq"))
    if numeric:
        def moments(c: str) -> Column:
            x = _col(c).cast("double")
            return F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                            F.min(x).alias("min"), F.max(x).alias("max"))

        numbers = df.select(*map(_col, numeric))
        stats = per_column(numbers, "s", moments).select("Column_name", "s.*")
        cells = F.array(*(F.struct(F.lit(c).alias("Column_name"), _col(c).cast("double").alias("number"))
                          for c in numeric))
        counts = (numbers.select(F.inline(cells)).filter(F.col("number").isNotNull())
                  .groupBy("Column_name", "number").agg(F.count(F.lit(1)).alias("count")))
        stats = stats.join(quantiles(counts, (0.25, 0.5, 0.75), ("p25", "p50", "p75")), "Column_name", "left")
    else:
        stats = base.select("Column_name", *(F.lit(None).cast("double").alias(n)
                                             for n in ("mean", "std", "min", "max", "p25", "p50", "p75")))
    return out.join(stats, "Column_name", "left").select(
        "Column_name", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_count_bars(df: DataFrame, column: str, threshold: int = VALUE_COUNT_THRESHOLD) -> DataFrame:
    """A10: rows per value, the values below the threshold pooled as ``all_other``."""
    value = as_text(df, column)
    counts = df.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return (counts.groupBy(F.when(F.col("count") < threshold, "all_other").otherwise(F.col("value")).alias("value"))
            .agg(F.sum("count").alias("count")))


def null_share_by_group(df: DataFrame, column: str, group: str, threshold: float = NULL_SHARE_THRESHOLD) -> DataFrame:
    """How the empty cells of a column are shared out over the groups, in percent."""
    value = _col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        empty = value.isNull() | (F.size(value) == 0)
    else:
        empty = missing_like(value, NO_VALUE)
    grouped = df.groupBy(_col(group).alias("value")).agg(F.count_if(empty).alias("empty"))
    total = F.greatest(grouped.agg(F.sum("empty")).scalar(), F.lit(1))
    return (grouped.filter(F.col("value").isNotNull())
            .select("value", F.round(100.0 * F.col("empty") / total, 2).alias("percentage"))
            .filter(F.col("percentage") > threshold))


def age_histogram(df: DataFrame, as_of: Column, column: str = "birth_date") -> DataFrame:
    """Rows per age in years; blank dates are left out."""
    return (df.filter(F.coalesce(_col(column), F.lit("")) != "")
            .groupBy(age_in_years(_col(column), as_of).cast("int").alias("age"))
            .agg(F.count(F.lit(1)).alias("count")))


def score_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Rows per equal-width bin of a score in [0, 1]; 1.0 belongs to the last bin."""
    bin_no = F.least(F.width_bucket(_col(column), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return df.groupBy(bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def statistics_tables(raw: DataFrame, clean: DataFrame) -> dict[str, DataFrame]:
    """The five comparison tables by name."""
    return {
        "memory_usage": size_table(raw, clean),
        "dtypes": dtypes_table(raw, clean),
        "unique_values": unique_table(raw, clean),
        "null_percentages": null_table(raw, clean),
        "generic_report": describe(clean),
    }


def statistics_plots(df: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The data behind the standard charts, for the columns that exist."""
    out = {}
    if "birth_date" in df.columns:
        out["age"] = age_histogram(df, as_of)
    for column in ("addresses_city", "sex"):
        if column in df.columns:
            out[column] = value_count_bars(df, column)
    if "origin" in df.columns:
        for column in REPORT_NULL_COLUMNS:
            if column in df.columns:
                out[f"{column}_empty"] = null_share_by_group(df, column, "origin", NULL_SHARE_REPORT_THRESHOLD)
    return out


def profile(raw: DataFrame, clean: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Tables and chart data of a cleaned dataset."""
    return statistics_tables(raw, clean) | {f"plot_{k}": v for k, v in statistics_plots(clean, as_of).items()}


def run_counts(records: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Records, columns and matches of a run."""
    found = matches.agg(F.count(F.lit(1))).scalar() if matches is not None else F.lit(None).cast("bigint")
    return records.agg(F.count(F.lit(1)).alias("records_count")).select(
        "records_count", F.lit(len(records.columns)).alias("columns_count"), found.alias("matches_found"))


def metric_summary(points: DataFrame) -> DataFrame:
    """Mean value per metric name."""
    return points.groupBy("name").agg(F.avg("value").alias("value"))
