"""Dataset readers S1-S5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CELL_CHARS = 3_000_000  # Fixed value: longest CSV cell


def read_csv(spark: SparkSession, path: str, *, encoding: str = "utf-8",
             cleaning_fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Header CSV, every column text, empty cells ''.

    Quoted cells may span lines, so one file is read by one task; a large
    dataset should arrive as many files (or as Parquet).  ``cleaning_fn`` (X2)
    is applied to every cell.
    """
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("encoding", encoding).option("maxCharsPerColumn", MAX_CELL_CHARS).csv(path))
    clean = cleaning_fn or (lambda c: c)
    return df.select(*(clean(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in df.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or one object holding the list under ``records``."""
    return _records(spark.read.option("multiLine", True).json(path), path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """S2 for files with one object per line, which Spark can split."""
    return _records(spark.read.json(path), path)


def _records(df: DataFrame, path: str) -> DataFrame:
    if df.columns == ["_corrupt_record"]:
        raise ValueError(f"no JSON records in {path}")
    if df.columns == ["records"]:
        records = df.schema["records"].dataType
        if not (isinstance(records, T.ArrayType) and isinstance(records.elementType, T.StructType)):
            raise ValueError("'records' must be a list of objects")
        return df.select(F.inline("records"))
    return df


_READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv,
    "json": read_json,
    "jsonl": read_json_lines,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def read_dataset(spark: SparkSession, path: str, *, fmt: str | None = None, limit: int | None = None,
                 order_by: str | None = None, **options) -> DataFrame:
    """Read by declared format or file suffix, optionally the first ``limit`` rows.

    With ``order_by`` the limit picks the same rows on every run.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in _READERS:
        raise ValueError(f"unsupported dataset format: {fmt!r}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    df = _READERS[fmt](spark, path, **options)
    if limit is None:
        return df
    return (df.orderBy(order_by) if order_by else df).limit(limit)


def decode_base64_files(df: DataFrame, content: str, out: str = "text") -> tuple[DataFrame, DataFrame]:
    """A column of base64 files to text; undecodable rows go to the second frame."""
    raw = F.try_to_binary(F.col(content), F.lit("base64"))
    decoded = df.withColumn(out, raw.try_cast("string"))
    return decoded.filter(F.col(out).isNotNull()), decoded.filter(F.col(out).isNull()).drop(out)
