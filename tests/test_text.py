"""Scalar, list and date functions on literal inputs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinfold.functions import text, validate


def one(spark, column, value="", schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("o")).first()["o"]


@pytest.mark.parametrize("raw, want", [
    ("ÉLÈVE  ", "eleve"), ("", ""), (None, ""), ("Cœur, Straße/Ægir", "coeur strasse aegir"),
    ("None", ""), ("x [] none y", "x y"), ("1990-01-01T00:00:00.000Z", "1990-01-01"),
    ("+33612", "0612"), ('"quoted"', "quoted"), ("'a'", "a"), ("a:b\nc", "a b c"), ("\tTab\x0bbed ", "tab bed"),
    ("nonesuch", "nonesuch"), ("Plain", "plain"), ("a  b", "a b"), ("1990-01-01 00:00:00.000", "1990-01-01"),
    ("ø łódź đ – “x” €5", 'o lodz d - "x" eur5'),
])
def test_normalize_text(spark, raw, want):
    assert one(spark, text.normalize_text("v"), raw) == want
    assert one(spark, text.normalize_text(F.col("v")), raw) == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=st.sampled_from(list("aZé ß\t\n,:/\"'[]+3none0T.-")), max_size=20), min_size=40, max_size=40))
def test_normalize_text_is_trimmed_and_lower(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    plain = text.steps_sql("coalesce(v, '')", text._NORMALIZE)
    for row in df.select("v", text.normalize_text("v").alias("o"), F.expr(plain).alias("steps")).collect():
        assert row.o == row.o.strip().lower() and "  " not in row.o
        assert row.o == row.steps  # the short cut for plain values changes nothing


def test_lists(spark):
    assert one(spark, text.parse_nested_list(F.col("v")), "John@@@Doe@@@John") == ["john", "doe"]
    assert one(spark, text.parse_nested_list(F.col("v")), None) == []
    assert one(spark, text.parse_nested_list(F.col("v")), " none ") == []
    mails = text.enrich_emails(F.col("v"))
    assert one(spark, mails, ["John.Doe@gmail.com"], "v array<string>") == ["john.doe@gmail.com", "john.doe"]
    assert one(spark, mails, [], "v array<string>") == []
    assert one(spark, mails, ["@x", "nomail", None, "a@b"], "v array<string>") == ["a@b", "a"]
    assert one(spark, text.clean_list(F.col("v")), ["none", "", "É"], "v array<string>") == ["e"]
    assert one(spark, text.clean_cell("v"), "no[]ne") == ""
    assert one(spark, text.normalize_birth_date("v"), "1990-01-01 00:00:00") == "1990-01-01"


def test_candidates(spark):
    df = spark.createDataFrame([(["Roe", "Doe", None], ["Jo", "jo", "Al"], [], ["b"], ["c", "d"])],
                               "f array<string>, g array<string>, s array<string>, m array<string>, c array<string>")
    names = text.full_name_candidates([F.col("f")], [F.col("g")])
    assert df.select(names).first()[0] == ["roe jo", "roe al", "doe jo", "doe al"]
    assert df.select(text.full_name_candidates([F.col("f")], [F.col("s")])).first()[0] == []
    spots = text.address_candidates(F.col("s"), F.col("m"), F.col("c"), F.col("s"))
    assert df.select(spots).first()[0] == ["b c", "b d"]


def test_casts_and_helpers(spark):
    assert one(spark, text.safe_int(F.col("v"), 7), "12") == 12
    assert one(spark, text.safe_int(F.col("v"), 7), "1.0") == 7
    assert one(spark, text.safe_float(F.col("v")), "x") is None
    assert one(spark, text.safe_str(F.col("v"), "d"), None) == "d"
    assert one(spark, text.remove_accents(F.col("v")), "Éœß ﬁn") == "Eœß fin"
    assert one(spark, text.normalize_no_accents(F.col("v")), "  ÉTÉ   là ") == "ete la"
    assert one(spark, text.is_ascii(F.col("v")), "abc") and not one(spark, text.is_ascii(F.col("v")), "é")
    assert one(spark, text.substrings_included(["b", "", "x", "a"], F.col("v")), "abc") == ["b", "a"]
    assert one(spark, text.chunk_list(F.col("v"), 2), ["a", "b", "c"], "v array<string>") == [["a", "b"], ["c"]]
    assert one(spark, text.chunk_list(F.col("v"), 2), [], "v array<string>") == []
    with pytest.raises(ValueError):
        text.chunk_list(F.col("v"), 0)
    assert len(one(spark, text.random_string(9, seed=1))) == 9
    payload = text.parse_json_payload(F.col("v"), "a int")
    assert one(spark, payload, bytearray(b'{"a": 3}'), "v binary").a == 3
    assert one(spark, text.missing_like(F.col("v")), "nan") and not one(spark, text.missing_like(F.col("v")), "NAN")


def test_age_rounds_half_to_even(spark):
    as_of = F.lit("2000-01-01").cast("date")
    assert one(spark, text.age_in_years(F.col("v"), as_of), "1990-01-01") == 10.0
    assert one(spark, text.age_in_years(F.col("v"), as_of), "bad") is None


def test_validation(spark):
    names = validate.valid_names(F.col("v"))
    assert one(spark, names, ["a"], "v array<string>")
    for bad in ([], ["a", " "], None):
        assert not one(spark, names, bad, "v array<string>")
    assert one(spark, validate.valid_addresses(F.col("v")), None, "v array<string>")
    assert not one(spark, validate.valid_emails(F.col("v")), ["a@b"], "v array<string>")
    assert one(spark, validate.valid_emails(F.col("v")), ["a@b.c"], "v array<string>")
    assert not one(spark, validate.valid_date_text(F.col("v")), "1990-1-1")
    assert one(spark, validate.safe_file(F.col("v")), "a/b.csv") and not one(spark, validate.safe_file(F.col("v")), "a b")
    assert not one(spark, validate.probability(F.col("v")), 1.5, "v double")


def test_scripts_and_long_numbers(spark):
    """Every script leaves keys; Greek, Cyrillic and full-width letters become Latin ones."""
    from twinfold.functions import blockkeys as bk

    names = ["Παπαδόπουλος", "Иванов", "Щукин", "ＡＢＣ１２", "田中 一郎", "Ёлка", "Ψυχή"]
    df = spark.createDataFrame([(n,) for n in names], "x string").withColumn("t", text.normalize_text("x"))
    got = {r.x: (r.t, r.k) for r in df.withColumn("k", bk.keys("token_field", "t")).collect()}
    assert [got[n][0] for n in names] == ["papadopoulos", "ivanov", "shchukin", "abc12", "田中 一郎", "elka", "psukhe"]
    assert all(k for _, k in got.values()) and got["田中 一郎"][1] == ["田中", "一郎"]
    accents = spark.createDataFrame([("Ά Й ｅ é",)], "x string").select(text.remove_accents("x").alias("y")).first().y
    assert accents == "Α И e e"
    digits = spark.createDataFrame([("0001234567890123456789012345 12 " + "9" * 60,)], "t string")
    key = lambda p: digits.select(bk.keys(p, "t").alias("k")).first().k
    n = 1234567890123456789012345
    assert key("first_integer") == [str(n)] and key("common_integer") == [str(n), "12", "9" * 60]
    assert key("near_integers") == [str(n - 1), str(n), str(n + 1), "11", "12", "13", "9" * 60]
    assert key("hundred_integer") == [str((n + 50) // 100 * 100), "0", "9" * 60]
    assert key("hundred_integers_odd") == [str((n + 50) // 100 * 100 + n % 2), "0", "9" * 60]
