"""Queries over the profiling tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators import profile
from twinfold.plans import dedupe
from twinfold.plans.oracle import over_clean, over_persons
from twinfold.plans.persons import clean_persons, persons, table
from twinfold.plans.registry import query

_TEXTS = ("origin", "sex", "birth_family_name", "birth_first_name", "birth_date")
_LISTS = ("emails", "telephones", "addresses_street", "addresses_city", "addresses_postal_code")
_IDS = ("id", "entity_id")
_ALL = (*_IDS, *_TEXTS, *_LISTS)
_MISSING = "({0} IS NULL OR CAST({0} AS VARCHAR) IN ('', 'nan', 'NaN', 'None', 'none'))"
_LIST_TEXT = ", ".join(f"'[' || array_to_string({c}, ', ') || ']' AS {c}" for c in _LISTS)
# raw and cleaned persons with every cell as text
_CELLS = f"""raw AS (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _ALL)} FROM persons),
cleaned AS (SELECT CAST(record_id AS VARCHAR) AS id, CAST(entity_id AS VARCHAR) AS entity_id, {', '.join(_TEXTS)}, {_LIST_TEXT} FROM clean)"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return persons(spark, sf).select(*_ALL)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_persons(spark, sf).select(*_ALL)


def _both(raw: str, cleaned: str, out_raw: str, out_clean: str) -> str:
    """One row per column with a figure of the raw and one of the cleaned cells."""
    return over_clean(" UNION ALL ".join(
        f"SELECT '{c}' AS Column_name, (SELECT {raw.format(c)} FROM raw) AS {out_raw}, "
        f"(SELECT {cleaned.format(c)} FROM cleaned) AS {out_clean}" for c in _ALL), _CELLS)


@query("a1_count_missing", over_persons(" UNION ALL ".join(
    f"SELECT '{c}' AS Column_name, count(*) FILTER (WHERE {_MISSING.format(c)}) AS missing FROM persons" for c in _ALL)))
def a1_count_missing(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_missing(_raw(spark, sf))


_SHARE = f"100.0 * count(*) FILTER (WHERE {_MISSING}) / count(*)"


@query("a2_null_percentages", over_persons(" UNION ALL ".join(
    f"SELECT '{c}' AS Column_name, {_SHARE.format(c)} AS Null_values FROM persons" for c in _ALL)))
def a2_null_percentages(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_percentages(_raw(spark, sf))


@query("a3_j5_null_table", _both(_SHARE, _SHARE, "Null_values_raw", "Null_values_clean"))
def a3_j5_null_table(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_table(_raw(spark, sf), _clean(spark, sf))


_UNIQUE = "count(DISTINCT {0}) FILTER (WHERE {0} NOT IN ('', 'NaN', 'nan'))"


@query("a4_unique_table", _both(_UNIQUE, _UNIQUE, "Unique_values_raw", "Unique_values_clean"))
def a4_unique_table(spark: SparkSession, sf: str) -> DataFrame:
    return profile.unique_table(_raw(spark, sf), _clean(spark, sf))


@query("a5_dtypes_table", over_persons(" UNION ALL ".join(
    f"SELECT '{c}' AS Column_name, '{'bigint' if c in _IDS else 'string'}' AS Data_types_raw, "
    f"'{'array<string>' if c in _LISTS else 'bigint' if c == 'entity_id' else 'string'}' AS Data_types_clean, "
    f"(SELECT count(*) FROM persons) AS records" for c in _ALL)))
def a5_dtypes_table(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf)
    return profile.dtypes_table(raw, _clean(spark, sf)).withColumn("records", raw.agg(F.count(F.lit(1))).scalar())


_BYTES = "CAST(sum(strlen({0})) AS BIGINT)"


@query("a6_size_table", _both(_BYTES, _BYTES, "Memory_bytes_raw", "Memory_bytes_clean"))
def a6_size_table(spark: SparkSession, sf: str) -> DataFrame:
    return profile.size_table(_raw(spark, sf), _clean(spark, sf))


_NUMERIC = "avg({0}) AS mean, stddev_samp({0}) AS std, min({0}) AS min, quantile_cont({0}, 0.25) AS p25, " \
           "quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.75) AS p75, max({0}) AS max"
_NO_NUMBERS = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))


def _describe_text(c: str, source: str) -> str:
    return (f"SELECT '{c}' AS Column_name, (SELECT count({c}) FROM {source}) AS count, (SELECT count(DISTINCT {c}) FROM {source}) AS \"unique\", "
            f"top, freq, {_NO_NUMBERS} FROM (SELECT {c} AS top, count(*) AS freq FROM {source} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")


def _describe_number(c: str, source: str) -> str:
    return (f"SELECT '{c}' AS Column_name, count({c}) AS count, NULL AS \"unique\", NULL AS top, NULL AS freq, "
            f"{_NUMERIC.format(c)} FROM {source}")


def _rounded(sql: str) -> str:
    numbers = ", ".join(f"round({n}, 4) AS {n}" for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return f"SELECT Column_name, count, \"unique\", top, freq, {numbers} FROM ({sql})"


def _described(df: DataFrame) -> DataFrame:
    return profile.describe(df).select("Column_name", "count", "unique", "top", "freq", *(
        F.round(n, 4).alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")))


@query("a7_generic_report", _rounded(" UNION ALL ".join([
    _describe_number("o_orderkey", "orders"), _describe_number("o_custkey", "orders"), _describe_text("o_orderstatus", "orders"),
    _describe_number("o_totalprice", "orders"), _describe_text("o_orderpriority", "orders"),
    _describe_text("o_orderdate", "(SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders)")])))
def a7_generic_report(spark: SparkSession, sf: str) -> DataFrame:
    return _described(table(spark, sf, "orders"))


@query("a8_statistics_tables", over_clean(_rounded(" UNION ALL ".join(
    [_describe_number("entity_id", "(SELECT CAST(entity_id AS BIGINT) AS entity_id FROM cleaned)")]
    + [_describe_text(c, "cleaned") for c in _ALL if c != "entity_id"])), _CELLS))
def a8_statistics_tables(spark: SparkSession, sf: str) -> DataFrame:
    tables = profile.statistics_tables(_raw(spark, sf), _clean(spark, sf))
    return tables["generic_report"].select("Column_name", "count", "unique", "top", "freq", *(
        F.round(n, 4).alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")))


_BARS = """SELECT value, CAST(sum(n) AS BIGINT) AS count FROM (
    SELECT CASE WHEN n < {t} THEN 'all_other' ELSE value END AS value, n FROM (
      SELECT {c} AS value, count(*) AS n FROM {f} WHERE {c} IS NOT NULL GROUP BY 1)) GROUP BY 1"""


@query("a10_value_count_bars", _BARS.format(t=40, c="p_size", f="(SELECT CAST(p_size AS VARCHAR) AS p_size FROM part)"))
def a10_value_count_bars(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_count_bars(table(spark, sf, "part"), "p_size", 40)


@query("a10_first_names", over_clean(_BARS.format(t=10, c="birth_first_name", f="clean")))
def a10_first_names(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_count_bars(clean_persons(spark, sf), "birth_first_name")


@query("a11_null_share", over_clean("""
    SELECT origin AS value, round(100.0 * count(*) FILTER (WHERE len(telephones) = 0)
           / greatest((SELECT count(*) FROM clean WHERE len(telephones) = 0), 1), 2) AS percentage
    FROM clean GROUP BY 1 HAVING percentage > 5"""))
def a11_null_share(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_share_by_group(clean_persons(spark, sf), "telephones", "origin")


_AGE = """SELECT CAST(round_even(date_diff('day', CAST(birth_date AS DATE), DATE '2024-01-01') / 365.0, 0) AS INT) AS age,
    count(*) AS count FROM clean WHERE birth_date <> '' GROUP BY 1"""


def _as_of():
    return F.lit("2024-01-01").cast("date")


@query("a12_age_histogram", over_clean(_AGE))
def a12_age_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.age_histogram(clean_persons(spark, sf), _as_of())


@query("a14_report_set", over_clean(f"""
    SELECT 'age' AS chart, CAST(age AS VARCHAR) AS value, CAST(count AS DOUBLE) AS figure FROM ({_AGE})
    UNION ALL SELECT 'sex', value, CAST(count AS DOUBLE) FROM ({_BARS.format(t=10, c='sex', f='clean')})
    UNION ALL SELECT 'addresses_city', value, CAST(count AS DOUBLE)
      FROM ({_BARS.format(t=10, c='addresses_city', f='cleaned')})
    """ + "".join(f"""
    UNION ALL SELECT '{c}_empty', origin, round(100.0 * count(*) FILTER (WHERE {e})
      / greatest((SELECT count(*) FROM clean WHERE {e}), 1), 2) AS p FROM clean GROUP BY 2 HAVING p > 2"""
                  for c, e in (("sex", "sex = ''"), ("addresses_city", "len(addresses_city) = 0"),
                               ("telephones", "len(telephones) = 0"), ("emails", "len(emails) = 0"))), _CELLS))
def a14_report_set(spark: SparkSession, sf: str) -> DataFrame:
    charts = profile.statistics_plots(clean_persons(spark, sf), _as_of())
    frames = [df.select(F.lit(name).alias("chart"), F.col(df.columns[0]).cast("string").alias("value"),
                        F.col(df.columns[1]).cast("double").alias("figure")) for name, df in charts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("a9_x3_eda_analysis", _both(_SHARE, _SHARE, "Null_values_raw", "Null_values_clean"))
def a9_x3_eda_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.run("edaAnalysis", _raw(spark, sf), _as_of())["null_percentages"].filter(F.col("Column_name").isin(*_ALL))


@query("a19_metric_summary", "SELECT event_type AS name, avg(value) AS value FROM events GROUP BY 1")
def a19_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return profile.metric_summary(table(spark, sf, "events").selectExpr("event_type as name", "value"))
