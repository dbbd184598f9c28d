"""Person records derived from the supplied tables, and the model used on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.config import FieldSpec, MatchConfig
from twinfold.operators.blocking import Rule, rule
from twinfold.operators.clean import preprocess
from twinfold.operators.scoring import MISSING, MatchModel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_customers(customer: DataFrame, part: DataFrame, nation: DataFrame) -> DataFrame:
    """One to three copies per customer with the errors that matching has to survive.

    Copy 1 has accents, case, padding, a typo in the first name and a time
    suffix; copy 2 lacks a letter of the family name, the birth date and the
    phone.  ``entity_id`` tells which records are the same person.
    """
    k = F.col("c_custkey")
    text_key = k.cast("string")
    base = (customer
            .join(part.select("p_partkey", "p_name"), k == F.col("p_partkey"))
            .join(nation.select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
            .select(k.alias("k"), F.col("c_mktsegment").alias("origin"), F.col("c_nationkey").alias("nk"),
                    F.col("n_name").alias("city"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w1"),
                    F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)),
                             F.translate(text_key, "0123456789", "aeioulnrst")).alias("w2")))
    k, w1, w2 = F.col("k"), F.col("w1"), F.col("w2")
    copies = F.array_compact(F.array(F.lit(0), F.when(k % 4 == 0, 1), F.when(k % 12 == 0, 2)))
    df = base.withColumn("cp", F.explode(copies))
    cp1, cp2 = F.col("cp") == 1, F.col("cp") == 2
    born = F.date_add(F.lit("1950-01-01").cast("date"), ((k * 37) % 20000).cast("int")).cast("string")
    mail = F.concat(w1, F.lit("."), w2, F.lit("@Example.com"))
    spare = F.concat(w2, F.lit("@mail.org"))
    phone = F.concat(F.lit("+33"), F.lpad(k.cast("string"), 9, "6"), F.when(k % 3 == 0, "@@@none").otherwise(""))
    return df.select(
        (k * 10 + F.col("cp")).alias("id"), k.alias("entity_id"), "origin",
        F.when((k % 11 == 0) & cp1, "").when(k % 2 == 0, "M").otherwise("F").alias("sex"),
        F.when(cp1, F.concat(F.lit(" "), F.upper(F.translate(w2, "e", "é")), F.lit(" ")))
         .when(cp2, F.concat(F.substring(w2, 1, 2), F.substring(w2, 4, 1000))).otherwise(w2).alias("birth_family_name"),
        F.when(cp1, F.concat(F.substring(w1, 1, 2), F.lit("x"), F.substring(w1, 3, 1000))).otherwise(w1)
         .alias("birth_first_name"),
        F.when(cp2, "").when(cp1, F.concat(born, F.lit("T00:00:00.000Z"))).otherwise(born).alias("birth_date"),
        F.when(cp2, spare).when(cp1, F.concat(mail, F.lit("@@@"), spare)).otherwise(mail).alias("emails"),
        F.when(cp2, "").otherwise(phone).alias("telephones"),
        F.concat((k % 97).cast("string"), F.lit(" rue "), w1).alias("addresses_street"),
        F.when(k % 7 == 0, "").otherwise(F.col("city")).alias("addresses_city"),
        F.lpad((F.col("nk") * 1000 + k % 50).cast("string"), 5, "0").alias("addresses_postal_code"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_customers(*(table(spark, sf_dir, t) for t in ("customer", "part", "nation")))


def clean_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned persons; ``record_id`` is the integer id that every row has."""
    df = preprocess(persons(spark, sf_dir), MatchConfig())
    return df.withColumns({"record_id": F.col("id").cast("bigint"), "entity_id": F.col("entity_id").cast("bigint")})


BLOCKING: tuple[Rule, ...] = (
    rule(("whole_field", "birth_family_name")),
    rule(("common_set_element", "emails")),
    rule(("same_seven_char_start", "birth_family_name"), ("whole_field", "birth_date")),
)

FIELDS = (
    FieldSpec("birth_family_name", "Edit", False, name="family_similarity"),
    FieldSpec("birth_family_name", "Exact", False, name="family_exact"),
    FieldSpec("birth_first_name", "Edit", False, name="first_similarity"),
    FieldSpec("emails", "Overlap", False),
    FieldSpec("telephones", "Overlap"),
    FieldSpec("birth_date", "Exact"),
)
MODEL = MatchModel(FIELDS, {
    "family_similarity": 4.0, "family_exact": 2.0, "first_similarity": 1.0, "emails": 4.0,
    "telephones": 2.0, "telephones" + MISSING: 0.6, "birth_date": 2.0, "birth_date" + MISSING: 0.6,
}, bias=-6.5)
