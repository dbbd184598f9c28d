"""Queries over blocking predicates and candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.config import FieldSpec
from twinfold.functions import blockkeys as bk
from twinfold.functions.phonetic import METAPHONE_RULES
from twinfold.operators import blocking
from twinfold.operators.blocking import rule
from twinfold.operators.scoring import MatchModel, matching_pairs
from twinfold.plans.oracle import over_clean
from twinfold.plans.persons import BLOCKING, clean_persons, table
from twinfold.plans.registry import query

# the text and the set the predicates are shown on; some texts have long digit runs and words of other scripts
_ODD = ("CASE WHEN record_id % 30 = 0 THEN '0098765432109876543210987' END", "CASE WHEN record_id % 20 = 0 THEN '田中 ελλη иван' END")
_TEXT = f"concat_ws(' ', {_ODD[0]}, birth_first_name, birth_family_name, addresses_street, addresses_postal_code, addresses_city, {_ODD[1]})"
_TEXT_SQL = (f"concat_ws(' ', {_ODD[0]}, birth_first_name, birth_family_name, addresses_street[1], addresses_postal_code[1], "
             f"addresses_city[1], {_ODD[1]})")
_VALUES = f"""v AS (
  SELECT record_id, {_TEXT_SQL} AS t, list_concat(emails, telephones) AS s FROM clean
), w AS (
  SELECT *, list_filter(string_split(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w,
         list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: CAST(x AS HUGEINT)) AS ints,
         replace(t, ' ', '') AS packed, list_sort(list_distinct(s)) AS u FROM v
)"""


def values(spark: SparkSession, sf: str) -> DataFrame:
    return clean_persons(spark, sf).selectExpr("record_id", f"{_TEXT} as t", "concat(emails, telephones) as s")


def _grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})))"


def _word_grams(n: int) -> str:
    return (f"list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT) - {n - 2}), "
            f"lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))")


def _metaphone_sql(word: str) -> str:
    s = f"regexp_replace({word}, '[^a-z]', '', 'g')"
    for letter in "abdefghijklmnopqrstuvwxyz":
        s = f"regexp_replace({s}, '{letter}{letter}+', '{letter}', 'g')"
    for pattern, code in METAPHONE_RULES:
        s = "regexp_replace({}, '{}', '{}', 'g')".format(s, pattern, code.replace("$", "\\"))
    return s


_METAPHONE = (f"list_filter(list_transform(list_transform(w, lambda x: {_metaphone_sql('x')}), "
              "lambda c: upper(concat(left(c, 1), regexp_replace(substr(c, 2), '[aeiou]', '', 'g')))), lambda x: x <> '')")

# name: (predicate, input column, keys in SQL)
_KEYS = {
    "k1_whole_field": ("whole_field", "t", "[t]"),
    "k2_token_field": ("token_field", "t", "list_distinct(w)"),
    "k3_first_token": ("first_token", "t", "[w[1]]"),
    "k4_first_two_tokens": ("first_two_tokens", "t", "[w[1] || ' ' || w[2]]"),
    "k5_common_integer": ("common_integer", "t", "list_distinct(ints)"),
    "k6_alpha_numeric": ("alpha_numeric", "t", "list_distinct(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))"),
    "k7_near_integers": ("near_integers", "t", "list_distinct(flatten(list_transform(ints, lambda n: [n - 1, n, n + 1])))"),
    "k8_hundred_integer": ("hundred_integer", "t", "list_distinct(list_transform(ints, lambda n: (n + 50) // 100 * 100))"),
    "k9_hundred_integers_odd": ("hundred_integers_odd", "t",
                                "list_distinct(list_transform(ints, lambda n: (n + 50) // 100 * 100 + n % 2))"),
    "k10_first_integer": ("first_integer", "t", "[ints[1]]"),
    "k11_ngram_tokens": ("ngram_tokens", "t", _word_grams(4)),
    "k12_common_two_tokens": ("common_two_tokens", "t", _word_grams(2)),
    "k13_common_three_tokens": ("common_three_tokens", "t", _word_grams(3)),
    "k14_fingerprint": ("fingerprint", "t", "[array_to_string(list_sort(w), ' ')]"),
    "k15_one_gram_fingerprint": ("one_gram_fingerprint", "t", f"[array_to_string(list_sort({_grams('packed', 1)}), '')]"),
    "k16_two_gram_fingerprint": ("two_gram_fingerprint", "t", f"[array_to_string(list_sort({_grams('packed', 2)}), '')]"),
    "k17_common_four_gram": ("common_four_gram", "t", _grams("t", 4)),
    "k18_common_six_gram": ("common_six_gram", "t", _grams("t", 6)),
    "k19_same_three_char_start": ("same_three_char_start", "t", "[left(t, 3)]"),
    "k20_same_five_char_start": ("same_five_char_start", "t", "[left(t, 5)]"),
    "k21_same_seven_char_start": ("same_seven_char_start", "t", "[left(t, 7)]"),
    "k22_suffix_array": ("suffix_array", "t",
                         "list_transform(range(1, length(packed) - 2), lambda i: substr(packed, i))"),
    "k23_sorted_acronym": ("sorted_acronym", "t",
                           "[array_to_string(list_sort(list_transform(w, lambda x: left(x, 1))), '')]"),
    "k24_metaphone_token": ("metaphone_token", "t", f"list_distinct({_METAPHONE})"),
    "k26_whole_set": ("whole_set", "s", "[array_to_string(u, ' ')]"),
    "k27_common_set_element": ("common_set_element", "s", "u"),
    "k28_common_two_elements": ("common_two_elements", "s",
                                "flatten(list_transform(u, lambda a, i: list_transform(list_slice(u, i + 1, len(u)), "
                                "lambda b: a || ' ' || b)))"),
    "k29_common_three_elements": ("common_three_elements", "s",
                                  "flatten(flatten(list_transform(u, lambda a, i: list_transform(list_slice(u, i + 1, len(u)), "
                                  "lambda b, j: list_transform(list_slice(u, i + j + 1, len(u)), "
                                  "lambda c: a || ' ' || b || ' ' || c)))))"),
    "k30_last_set_element": ("last_set_element", "s", "[u[-1]]"),
    "k31_first_set_element": ("first_set_element", "s", "[u[1]]"),
    "k32_magnitude_of_cardinality": ("magnitude_of_cardinality", "s", "[CAST(round(log10(len(u))) AS INT)]"),
}


def _register_keys(name: str, predicate: str, column: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = values(spark, sf)
        made = F.expr(bk.ngram_tokens(column, 4)) if predicate == "ngram_tokens" else bk.keys(predicate, column)
        return df.select("record_id", F.explode(made).alias("block_key"))

    oracle = over_clean(
        f"SELECT record_id, CAST(unnest({sql}) AS VARCHAR) AS block_key FROM w", _VALUES)
    query(name, oracle)(run)


for _name, (_predicate, _column, _sql) in _KEYS.items():
    _register_keys(_name, _predicate, _column, _sql)


# Double Metaphone codes of the words in part names, by the published rules.
_PART_CODES = {
    "anvil": ("ANFL",), "blue": ("PL",), "bolt": ("PLT",), "cold": ("KLT",), "gear": ("JR", "KR"), "gizmo": ("JSM", "KSM"), "hot": ("HT",),
    "large": ("LRJ", "LRK"), "new": ("N", "NF"), "old": ("ALT",), "plate": ("PLT",), "red": ("RT",), "ring": ("RNK",), "rod": ("RT",),
    "small": ("SML", "XML"), "widget": ("AJT", "FJT"),
}


@query("k25_double_metaphone", f"""
    SELECT DISTINCT p_partkey, c.code AS block_key FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) p
    JOIN (VALUES {', '.join(f"('{w}', '{c}')" for w, codes in _PART_CODES.items() for c in codes)}) c(word, code) ON c.word = p.word""")
def k25_double_metaphone(spark: SparkSession, sf: str) -> DataFrame:
    parts = bk.with_phonetic(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"])
    return parts.select("p_partkey", F.explode(bk.keys("double_metaphone", "p_name")).alias("block_key"))


@query("k33_lat_long_grid", """
    WITH g AS (SELECT c_custkey, c_nationkey * 1.5 - 18 AS lat, c_custkey % 360 - 180.25 AS lon FROM customer)
    SELECT c_custkey, concat(CAST(CAST(round(CAST(lat AS DECIMAL(12,6)), 1) AS DECIMAL(12,1)) AS VARCHAR), '_',
           CAST(CAST(round(CAST(lon AS DECIMAL(12,6)), 1) AS DECIMAL(12,1)) AS VARCHAR)) AS block_key FROM g""")
def k33_lat_long_grid(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_nationkey * 1.5D - 18 as lat", "c_custkey % 360 - 180.25D as lon")
    return places.select("c_custkey", F.explode(F.expr(bk.lat_long_grid("lat", "lon"))).alias("block_key"))


@query("k34_order_of_magnitude", """
    SELECT c_custkey, CAST(CAST(round(log10(c_acctbal)) AS INT) AS VARCHAR) AS block_key FROM customer WHERE c_acctbal > 0""")
def k34_order_of_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.explode(bk.keys("order_of_magnitude", "c_acctbal")).alias("block_key"))


@query("k35_round_to_1", """
    SELECT o_orderkey, CAST(CAST(round(o_totalprice / pow(10.0, floor(log10(abs(o_totalprice)))))
           * pow(10.0, floor(log10(abs(o_totalprice)))) AS DECIMAL(30,6)) AS VARCHAR) AS block_key
    FROM orders WHERE o_totalprice <> 0""")
def k35_round_to_1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.explode(bk.keys("round_to_1", "o_totalprice")).alias("block_key"))


# ---- candidate pairs ---------------------------------------------------------------------

PERSON_KEYS = """block_keys AS (
  SELECT record_id, 0 AS rule, birth_family_name AS k FROM clean WHERE birth_family_name <> ''
  UNION ALL SELECT record_id, 1, unnest(emails) FROM clean
  UNION ALL SELECT record_id, 2, concat(left(birth_family_name, 7), chr(31), birth_date) FROM clean WHERE birth_family_name <> '' AND birth_date <> ''
)"""
PERSON_PAIRS = """pairs AS (
  SELECT DISTINCT a.record_id AS left_id, b.record_id AS right_id
  FROM block_keys a JOIN block_keys b ON a.rule = b.rule AND a.k = b.k AND a.record_id < b.record_id
)"""


@query("j1_candidate_pairs", over_clean("SELECT left_id, right_id FROM pairs", PERSON_KEYS, PERSON_PAIRS))
def j1_candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.candidate_pairs(clean_persons(spark, sf), BLOCKING)


@query("u1_block_sizes", over_clean("SELECT rule, k AS key, count(*) AS records FROM block_keys GROUP BY 1, 2", PERSON_KEYS))
def u1_block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.block_sizes(blocking.block_table(clean_persons(spark, sf), BLOCKING))


@query("j3_compound_blocks", over_clean("""
    SELECT a.record_id AS left_id, b.record_id AS right_id FROM clean a JOIN clean b
    ON a.record_id < b.record_id AND left(a.birth_family_name, 7) = left(b.birth_family_name, 7)
       AND a.birth_family_name <> '' AND a.birth_date = b.birth_date AND a.birth_date <> ''
    UNION
    SELECT a.record_id, b.record_id FROM clean a JOIN clean b
    ON a.record_id < b.record_id AND a.addresses_postal_code[1] = b.addresses_postal_code[1]
       AND a.addresses_street[1] = b.addresses_street[1]"""))
def j3_compound_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rules = [rule(("same_seven_char_start", "birth_family_name"), ("whole_field", "birth_date")),
             rule(("common_set_element", "addresses_postal_code"), ("common_set_element", "addresses_street"))]
    return blocking.candidate_pairs(clean_persons(spark, sf), rules)


# parts: eight words fill the whole table, so every token block is hot
_PART_FIELDS = (FieldSpec("p_brand", "Exact", False), FieldSpec("p_type", "Exact", False), FieldSpec("p_size", "Exact", False),
                FieldSpec("p_name", "Edit", False, name="name_similarity"))
_PART_MODEL = MatchModel(_PART_FIELDS, {"p_brand": 2.0, "p_type": 1.0, "p_size": 2.0, "name_similarity": 1.0}, bias=-5.0)


@query("j6_hot_token_blocks", """
    WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part),
    pairs AS (SELECT DISTINCT a.p_partkey AS left_id, b.p_partkey AS right_id FROM t a JOIN t b ON a.k = b.k AND a.p_partkey < b.p_partkey),
    scored AS (SELECT left_id, right_id, 1 / (1 + exp(-(-5.0 + CASE WHEN l.p_brand = r.p_brand THEN 2 ELSE 0 END
          + CASE WHEN l.p_type = r.p_type THEN 1 ELSE 0 END + CASE WHEN l.p_size = r.p_size THEN 2 ELSE 0 END
          + 1 - levenshtein(l.p_name, r.p_name) / greatest(length(l.p_name), length(r.p_name))))) AS score
      FROM pairs JOIN part l ON l.p_partkey = left_id JOIN part r ON r.p_partkey = right_id)
    SELECT left_id, right_id, round(score, 6) AS score FROM scored WHERE score >= 0.6""")
def j6_hot_token_blocks(spark: SparkSession, sf: str) -> DataFrame:
    # a token is only ever used together with the further agreements the score calls for
    parts = table(spark, sf, "part").selectExpr("p_partkey as record_id", "p_brand", "p_type",
                                                "cast(p_size as string) as p_size", "p_name")
    pairs = matching_pairs(parts, [rule(("token_field", "p_name"))], _PART_MODEL, 0.6)
    return pairs.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("j7_hydrated_pairs", over_clean("""
    SELECT left_id, right_id, l.birth_family_name AS left_name, r.birth_family_name AS right_name, l.birth_date AS left_date,
           r.birth_date AS right_date
    FROM pairs JOIN clean l ON l.record_id = left_id JOIN clean r ON r.record_id = right_id""", PERSON_KEYS, PERSON_PAIRS))
def j7_hydrated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf)
    pairs = blocking.candidate_pairs(people, BLOCKING)
    full = blocking.hydrate(pairs, people, ["birth_family_name", "birth_date"])
    return full.selectExpr("left_id", "right_id", "l.birth_family_name as left_name", "r.birth_family_name as right_name",
                           "l.birth_date as left_date", "r.birth_date as right_date")


@query("a16_blocking_efficiency", over_clean("""
    SELECT rule, count(*) AS blocks, max(n) AS largest_block, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS comparisons,
           any_value(d) AS distinct_pairs, any_value(CAST(t AS BIGINT)) AS all_pairs, any_value(1 - d / t) AS reduction_ratio
    FROM (SELECT rule, k, count(*) AS n FROM block_keys GROUP BY 1, 2),
         (SELECT count(*) AS d FROM pairs), (SELECT count(*) * (count(*) - 1) / 2 AS t FROM clean)
    GROUP BY rule""", PERSON_KEYS, PERSON_PAIRS))
def a16_blocking_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf)
    return blocking.blocking_efficiency(people, BLOCKING, blocking.candidate_pairs(people, BLOCKING))


@query("a16_pair_completeness", over_clean("""
    SELECT count(*) AS true_pairs, count(p.left_id) AS found_pairs, round(count(p.left_id) / count(*), 6) AS completeness
    FROM (SELECT a.record_id AS left_id, b.record_id AS right_id FROM clean a JOIN clean b
          ON a.entity_id = b.entity_id AND a.record_id < b.record_id) t
    LEFT JOIN pairs p ON p.left_id = t.left_id AND p.right_id = t.right_id""", PERSON_KEYS, PERSON_PAIRS))
def a16_pair_completeness(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf)
    truth = blocking.candidate_pairs(people.withColumn("entity", F.col("entity_id").cast("string")),
                                     [rule(("whole_field", "entity"))])
    return blocking.pair_completeness(blocking.candidate_pairs(people, BLOCKING), truth)
