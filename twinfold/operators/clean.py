"""Dataset cleaning: P1-P8 and the valid/quarantine split P17."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.config import LIST_COLUMNS, MatchConfig
from twinfold.functions import text
from twinfold.operators.ranking import with_row_index
from twinfold.sources.lineage import cut_lineage


def ensure_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Add the missing columns, [] for known list columns and '' otherwise."""
    missing = [c for c in dict.fromkeys(required) if c not in df.columns]
    empty_list = F.array().cast("array<string>")
    return df.withColumns({c: empty_list if c in LIST_COLUMNS else F.lit("") for c in missing}) if missing else df


def _is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def _cleaned(df: DataFrame, column: str, nested: Sequence[str]) -> Column:
    name = f"`{column}`"
    c = F.col(name)
    if column in nested:
        items = text.parse_nested_list(c, is_array=_is_array(df, column))
        return text.enrich_emails(items) if column == "emails" else items
    if _is_array(df, column):
        return text.clean_list(c)
    return text.normalize_birth_date(name) if column == "birth_date" else text.normalize_text(name)


def clean_scalar_columns(df: DataFrame, nested: Sequence[str]) -> DataFrame:
    """Normalise every column that is not list-valued."""
    return df.select(*(F.col(f"`{c}`") if c in nested else text.normalize_text(f"`{c}`").alias(c)
                       for c in df.columns))


def parse_nested_columns(df: DataFrame, nested: Sequence[str]) -> DataFrame:
    """Parse the list-valued columns that exist."""
    return df.select(*(text.parse_nested_list(F.col(f"`{c}`"), _is_array(df, c)).alias(c) if c in nested
                       else F.col(f"`{c}`") for c in df.columns))


def preprocess(df: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """The whole cleaning as one projection."""
    df = ensure_columns(df, config.nested_columns)
    return df.select(*(_cleaned(df, c, config.nested_columns).alias(c) for c in df.columns))


def add_candidates(df: DataFrame) -> DataFrame:
    """P5: the spellings of full names and addresses, as list columns."""
    df = ensure_columns(df, (
        "birth_family_name", "usage_family_name", "birth_first_name", "usage_first_name",
        "birth_family_name_list", "birth_first_name_list",
        "addresses_street", "addresses_complement", "addresses_city", "addresses_postal_code"))

    def spellings(kind: str) -> list[Column]:
        return [F.array(f"birth_{kind}", f"usage_{kind}"), F.col(f"birth_{kind}_list")]

    return df.withColumns({
        "all_full_names": text.full_name_candidates(spellings("family_name"), spellings("first_name")),
        "all_addresses": text.address_candidates(
            *(F.col(f"addresses_{p}") for p in ("street", "complement", "city", "postal_code"))),
    })


def with_record_id(df: DataFrame, id_column: str = "id", order_by: Sequence[str] | None = None) -> DataFrame:
    """``record_id`` from the id where it is an integer, else a number above the largest id.

    Only the id-less rows are numbered, in ``order_by`` or scan order; the
    others are not shuffled.
    """
    # read three times: the known ids, the largest of them, the rows without one
    keyed = cut_lineage(df.withColumn("record_id", text.safe_int(F.col(id_column))))
    known, unknown = keyed.filter(F.col("record_id").isNotNull()), keyed.filter(F.col("record_id").isNull())
    top = known.agg(F.coalesce(F.max("record_id"), F.lit(0))).scalar()
    numbered = with_row_index(unknown, order_by).withColumn("record_id", top + 1 + F.col("__index"))
    return known.unionByName(numbered.select(*known.columns))


def repeated_ids(df: DataFrame, id_column: str = "record_id") -> DataFrame:
    """Ids carried by more than one row, with their number of rows."""
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def with_errors(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``errors`` lists the names of the rules a row breaks."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return df.withColumn("errors", F.array_compact(broken))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the quarantined rows with their errors."""
    checked = with_errors(df, rules)
    return (checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0))


def require_rows(df: DataFrame) -> DataFrame:
    """Fail on an empty dataset."""
    if df.isEmpty():
        raise ValueError("dataset has no rows")
    return df
