"""Quality rules with adaptive thresholds (DataFrame functions only).

Each text gets counts; the spread of three shares derived from them is
summarised in mergeable quantile sketches per language and source, and a text
is rejected where it lies far outside the middle half of its own kind.

Kinds with fewer than ``min_rows`` texts take the sketch of their language, and
languages with fewer take that of all texts.  Only texts that pass the base
rules enter the sketches.

Nulls: a null text has no words and fails; null languages and sources are kinds
of their own.  Repeated rows count as often as they stand there.  An empty table
gives an empty result.  Extra columns are carried along; those named like a count,
a share or a verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.sources.lineage import stored

_SPACES = r"[\x20\x09-\x0D]+"
_ACCURACY = 10_000  # of the sketches: a rank is off by a 10,000th of the rows at most
MIN_ROWS = 100
#: share: (how many interquartile ranges beyond the quartile are allowed, and at least this much)
FENCES = {"symbol_share": (3.0, 0.1), "dup_line_share": (3.0, 0.4), "word_length": (3.0, 1.5)}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def _repeat_words() -> tuple[Column, Column]:
    """The sorted 3-word windows (from ``__g``), and how many words repeated ones cover (from those as ``__s``)."""
    ranked = F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(x: Column, j: Column) -> Column:
        near = F.col("__s")
        return F.coalesce(F.get(near, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(near, j + 1)["h"] == x["h"], F.lit(False))

    covered = F.flatten(F.transform(F.filter("__s", repeated), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return ranked, F.size(F.array_distinct(covered)).cast("bigint")


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts and ``base_failed``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ranked, covered = _repeat_words()
    grams = F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))),
                        lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))
    out = (docs.withColumn("__w", words(F.col(text_column))).withColumn("__l", lines)
           .withColumn("__g", grams)
           .withColumn("__s", F.when(F.size("__g") > F.size(F.array_distinct("__g")), ranked))
           .withColumn("n_words", F.size("__w").cast("bigint"))
           .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("bigint"))
           .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"))
           .withColumn("n_lines", F.size("__l").cast("bigint"))
           .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"))
           .withColumn("n_repeat_words", F.when(F.col("__s").isNull(), F.lit(0).cast("bigint")).otherwise(covered)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(text_column, "__w", "__l", "__g", "__s")


def _shares(df: DataFrame) -> DataFrame:
    some = F.col("n_words") > 0
    return (df.withColumn("symbol_share", F.when(some, F.col("n_symbols") / F.col("n_words")))
            .withColumn("dup_line_share", F.when(some, F.col("n_dup_lines") / F.col("n_lines")))
            .withColumn("word_length", F.when(some, F.col("word_chars") / F.col("n_words"))))


def _kind(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def thresholds(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """``__lang, __source`` and ``__low_``/``__high_`` of each share, one row per kind in ``measured``."""
    quartiles = [F.percentile_approx(c, [0.25, 0.75], _ACCURACY).alias(c) for c in FENCES]
    # a kind without passing texts still gets the thresholds of its language
    passing = [F.when(F.col("base_failed"), None).otherwise(F.col(c)).alias(c) for c in FENCES]
    sketched = (measured.select("__lang", "__source", *passing)
                .rollup("__lang", "__source")
                .agg(F.grouping_id().alias("level"), F.count("word_length").alias("rows"), *quartiles))
    sketched = stored(sketched, "sketches")
    value = F.struct("rows", *FENCES)
    kinds = sketched.filter("level = 0").select("__lang", "__source", value.alias("own"))
    langs = sketched.filter("level = 1").select("__lang", value.alias("lang"))
    every = sketched.filter("level = 3").select(value.alias("every")).scalar()
    chosen = (kinds.join(langs, "__lang")
              .withColumn("q", F.when(F.col("own.rows") >= min_rows, F.col("own"))
                          .when(F.col("lang.rows") >= min_rows, F.col("lang")).otherwise(every)))
    bounds = []
    for c, (times, least) in FENCES.items():
        q1, q3 = F.col(f"q.{c}")[0], F.col(f"q.{c}")[1]
        reach = F.greatest(times * (q3 - q1), F.lit(least))
        bounds += [(q1 - reach).alias(f"__low_{c}"), (q3 + reach).alias(f"__high_{c}")]
    return chosen.select("__lang", "__source", *bounds)


def judge(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
          min_rows: int = MIN_ROWS) -> DataFrame:
    """``docs`` without its text, with counts, shares, ``base_failed`` and ``kept``."""
    measured = _shares(measure(docs, text_column)).withColumn("__lang", _kind(lang_column)).withColumn("__source", _kind(source_column))
    measured = stored(measured, "measured")
    bounds = stored(thresholds(measured, min_rows), "thresholds")
    fits = F.lit(True)
    for c in FENCES:
        inside = (F.col(c) <= F.col(f"__high_{c}")) & (F.col(c) >= F.col(f"__low_{c}"))
        fits = fits & F.coalesce(inside, F.lit(True))
    drop = ["__lang", "__source", *(f"__{side}_{c}" for side in ("low", "high") for c in FENCES)]
    return (measured.join(bounds, ["__lang", "__source"], "left")
            .withColumn("kept", ~F.col("base_failed") & fits).drop(*drop))


SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols / n_words END AS a, CASE WHEN n_words > 0 THEN n_dup_lines / n_lines END AS b,
    CASE WHEN n_words > 0 THEN word_chars / n_words END AS c FROM m
), q AS (
  SELECT lang, source, GROUPING(lang, source) AS level, count(*) AS rows, quantile_disc(a, 0.25) AS a1, quantile_disc(a, 0.75) AS a3,
    quantile_disc(b, 0.25) AS b1, quantile_disc(b, 0.75) AS b3, quantile_disc(c, 0.25) AS c1, quantile_disc(c, 0.75) AS c3
  FROM s WHERE NOT base_failed GROUP BY ROLLUP (lang, source)
), r AS (
  SELECT s.*, CASE WHEN coalesce(k.rows, 0) >= 100 THEN k ELSE CASE WHEN coalesce(g.rows, 0) >= 100 THEN g ELSE e END END AS q
  FROM s LEFT JOIN q k ON k.level = 0 AND k.lang IS NOT DISTINCT FROM s.lang AND k.source IS NOT DISTINCT FROM s.source
  LEFT JOIN q g ON g.level = 1 AND g.lang IS NOT DISTINCT FROM s.lang LEFT JOIN q e ON e.level = 3
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND a <= q.a3 + greatest(3 * (q.a3 - q.a1), 0.1) AND a >= q.a1 - greatest(3 * (q.a3 - q.a1), 0.1)
  AND b <= q.b3 + greatest(3 * (q.b3 - q.b1), 0.4) AND b >= q.b1 - greatest(3 * (q.b3 - q.b1), 0.4)
  AND c <= q.c3 + greatest(3 * (q.c3 - q.c1), 1.5) AND c >= q.c1 - greatest(3 * (q.c3 - q.c1), 1.5) AS kept
FROM r
"""
