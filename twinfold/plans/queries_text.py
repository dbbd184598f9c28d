"""Queries over cleaning, validation and scalar functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.config import MatchConfig, select_fields
from twinfold.functions import text, validate
from twinfold.operators import clean
from twinfold.plans.oracle import distinct, norm, over_clean, over_persons, parsed
from twinfold.plans.persons import clean_persons, persons, table
from twinfold.plans.registry import query
from twinfold.sources import readers
from twinfold.sources.lineage import scratch_path


def joined(c: str) -> str:
    return f"array_join({c}, '|') as {c}"


# ---- sources ---------------------------------------------------------------------------

_PERSON_COLUMNS = ("id", "entity_id", "origin", "sex", "birth_family_name", "birth_first_name", "birth_date", "emails",
                   "telephones", "addresses_street", "addresses_city", "addresses_postal_code")


@query("s1_csv_source", over_persons(
    "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _PERSON_COLUMNS) + " FROM persons"))
def s1_csv_source(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "persons-csv")
    persons(spark, sf).write.option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path)


@query("s2_json_source", over_persons("SELECT id, birth_family_name, emails FROM persons"))
def s2_json_source(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "persons-json")
    # one object with a list of records per line
    people = persons(spark, sf).select("id", "birth_family_name", "emails")
    people.select(F.array(F.struct("*")).alias("records")).write.json(path)
    return readers.read_json_lines(spark, path)


@query("s3_dataset_by_suffix", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s3_dataset_by_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_dataset(spark, f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")


@query("s4_parquet_pruned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s4_parquet_pruned(spark: SparkSession, sf: str) -> DataFrame:
    orders = readers.read_dataset(spark, f"{sf}/orders.parquet", fmt="parquet")
    return orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s5_base64_files", """
    SELECT doc_id, lang <> 'de' AS decoded, CASE WHEN lang <> 'de' THEN md5(text) END AS digest FROM documents""")
def s5_base64_files(spark: SparkSession, sf: str) -> DataFrame:
    encoded = table(spark, sf, "documents").select(
        "doc_id", F.expr("concat(if(lang = 'de', '#', ''), base64(encode(text, 'UTF-8')))").alias("content"))
    good, bad = readers.decode_base64_files(encoded, "content")
    return good.select("doc_id", F.lit(True).alias("decoded"), F.md5("text").alias("digest")).unionByName(
        bad.select("doc_id", F.lit(False).alias("decoded"), F.lit(None).cast("string").alias("digest")))


# ---- projections and cleaning ------------------------------------------------------------


@query("p1_ensure_columns", over_persons(
    "SELECT id, '' AS usage_first_name, 0 AS n_first_names, telephones FROM persons"))
def p1_ensure_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.ensure_columns(persons(spark, sf), ["usage_first_name", "birth_first_name_list", "telephones"])
    return df.selectExpr("id", "usage_first_name", "size(birth_first_name_list) as n_first_names", "telephones")


@query("p2_clean_scalars", over_persons(
    "SELECT " + ", ".join(f"{norm(c)} AS {c}" for c in _PERSON_COLUMNS[:7]) + " FROM persons"))
def p2_clean_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_scalar_columns(persons(spark, sf).select(*_PERSON_COLUMNS[:7]), MatchConfig().nested_columns)


@query("p3_parse_nested", over_persons(
    "SELECT id, array_to_string(emails, '|') AS emails, array_to_string(telephones, '|') AS telephones FROM "
    f"(SELECT id, {distinct('emails')} AS emails, {distinct('telephones')} AS telephones FROM "
    f"(SELECT id, {parsed('emails')} AS emails, {parsed('telephones')} AS telephones FROM persons))"))
def p3_parse_nested(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.parse_nested_columns(persons(spark, sf), MatchConfig().nested_columns)
    return df.selectExpr("id", joined("emails"), joined("telephones"))


_CLEAN_LISTS = ("emails", "telephones", "addresses_street", "addresses_city", "addresses_postal_code")


@query("p4_preprocess", over_clean(
    "SELECT record_id, entity_id, origin, sex, birth_family_name, birth_first_name, birth_date, "
    + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in _CLEAN_LISTS) + " FROM clean"))
def p4_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return clean_persons(spark, sf).selectExpr(
        "record_id", "entity_id", "origin", "sex", "birth_family_name", "birth_first_name", "birth_date",
        *(joined(c) for c in _CLEAN_LISTS))


@query("p5_candidates", over_clean("""
    SELECT record_id, concat(birth_family_name, ' ', birth_first_name) AS all_full_names,
           concat_ws(' ', addresses_street[1], addresses_city[1], addresses_postal_code[1]) AS all_addresses FROM clean"""))
def p5_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return clean.add_candidates(clean_persons(spark, sf)).selectExpr(
        "record_id", joined("all_full_names"), joined("all_addresses"))


@query("p6_record_ids", """
    WITH mixed AS (SELECT c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS id
                   FROM customer)
    SELECT c_name, try_cast(id AS BIGINT) AS record_id FROM mixed WHERE try_cast(id AS BIGINT) IS NOT NULL
    UNION ALL
    SELECT c_name, (SELECT max(try_cast(id AS BIGINT)) FROM mixed) + row_number() OVER (ORDER BY c_name)
    FROM mixed WHERE try_cast(id AS BIGINT) IS NULL""")
def p6_record_ids(spark: SparkSession, sf: str) -> DataFrame:
    mixed = table(spark, sf, "customer").selectExpr(
        "c_name", "if(c_mktsegment = 'BUILDING', c_name, cast(c_custkey as string)) as id")
    return clean.with_record_id(mixed, "id", order_by=["c_name"]).select("c_name", "record_id")


@query("p6_repeated_ids", "SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def p6_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    return clean.repeated_ids(table(spark, sf, "orders"), "o_custkey")


@query("p8_limited_read", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def p8_limited_read(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_dataset(spark, f"{sf}/customer.parquet", limit=100, order_by="c_custkey").select("c_custkey", "c_name")


_SELECTED = (("sex", "Exact"), ("birth_first_name", "String"), ("birth_family_name", "String"), ("birth_date", "DateTime"),
             ("addresses_street", "Custom"), ("addresses_city", "Custom"), ("addresses_postal_code", "Custom"),
             ("emails", "Custom"), ("telephones", "Custom"))


@query("p9_selected_fields", over_persons(" UNION ALL ".join(
    f"SELECT '{f}' AS field, '{t}' AS type, count(*) FILTER ({f} <> '') AS filled FROM persons" for f, t in _SELECTED)))
def p9_selected_fields(spark: SparkSession, sf: str) -> DataFrame:
    people = persons(spark, sf)
    specs = [s for s in select_fields(people.columns, MatchConfig()) if s.type != "Interaction"]
    counts = F.array(*(F.struct(F.lit(s.field).alias("field"), F.lit(s.type).alias("type"),
                                F.count_if(F.col(s.field) != "").alias("filled")) for s in specs))
    return people.agg(counts.alias("t")).select(F.inline("t"))


# ---- validation --------------------------------------------------------------------------

_REQUESTS = """requests AS (
    SELECT record_id, [birth_family_name] AS family_name_list, [birth_first_name] AS first_name_list,
           CASE WHEN sex = '' THEN NULL ELSE addresses_city END AS address_complete_list, emails, birth_date FROM clean)"""
_OK = r"""NOT list_contains(list_transform({0}, lambda x: coalesce({1}, false)), false)"""
_EMAIL_OK = _OK.format("emails", r"regexp_matches(x, '^[^@\s]+@[^@\s]+\.[^@\s]+$')")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Linkage requests made of the cleaned persons: local parts make some e-mails invalid."""
    return clean_persons(spark, sf).selectExpr(
        "record_id", "array(birth_family_name) as family_name_list", "array(birth_first_name) as first_name_list",
        "if(sex = '', null, addresses_city) as address_complete_list", "emails", "birth_date")


def request_rules() -> dict:
    c = F.col
    return {
        "family_name_list": validate.valid_names(c("family_name_list")),
        "first_name_list": validate.valid_names(c("first_name_list")),
        "address_complete_list": validate.valid_addresses(c("address_complete_list")),
        "emails": validate.valid_emails(c("emails")),
        "birth_date": validate.valid_date_text(c("birth_date")),
    }


@query("p11_p14_validation", over_clean(rf"""
    SELECT record_id, family_name_list[1] <> '' AS names_ok, true AS address_ok, {_EMAIL_OK} AS emails_ok,
           regexp_matches(birth_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') AS date_ok FROM requests""", _REQUESTS))
def p11_p14_validation(spark: SparkSession, sf: str) -> DataFrame:
    rules = request_rules()
    return requests(spark, sf).select(
        "record_id", rules["family_name_list"].alias("names_ok"), rules["address_complete_list"].alias("address_ok"),
        rules["emails"].alias("emails_ok"), rules["birth_date"].alias("date_ok"))


@query("p15_safe_names", r"""
    SELECT page_id, regexp_matches(url, '^[a-zA-Z0-9._:/\-]+$') AS name_ok, regexp_matches(url, '^[a-zA-Z0-9._/\-]+$') AS file_ok,
           regexp_matches(url, '^[A-Za-z0-9+/=\s]+$') AS base64_ok FROM pages""")
def p15_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", validate.safe_name(url).alias("name_ok"),
                                            validate.safe_file(url).alias("file_ok"), validate.base64_like(url).alias("base64_ok"))


@query("p16_range_checks", """
    SELECT event_id, value BETWEEN 0 AND 1 AS probability_ok, value >= 1 AS limit_ok FROM events""")
def p16_range_checks(spark: SparkSession, sf: str) -> DataFrame:
    events = clean.require_rows(table(spark, sf, "events"))
    return events.select("event_id", validate.probability(F.col("value")).alias("probability_ok"),
                         validate.positive_limit(F.col("value")).alias("limit_ok"))


@query("p17_quarantine", over_clean(rf"""
    SELECT record_id, array_to_string(list_filter([
        CASE WHEN NOT {_EMAIL_OK} THEN 'emails' END,
        CASE WHEN NOT regexp_matches(birth_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'birth_date' END], lambda e: e IS NOT NULL), ',') AS errors
    FROM requests""", _REQUESTS))
def p17_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = clean.split_valid(requests(spark, sf), request_rules())
    return good.selectExpr("record_id", "'' as errors").unionByName(
        bad.selectExpr("record_id", "array_join(errors, ',') as errors"))


# ---- scalar functions --------------------------------------------------------------------


@query("c1_normalize_text", f"SELECT doc_id, md5(n) AS digest, length(n) AS n_chars FROM (SELECT doc_id, {norm('text')} AS n FROM documents)")
def c1_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", text.normalize_text("text").alias("n"))
    return df.selectExpr("doc_id", "md5(n) as digest", "cast(length(n) as bigint) as n_chars")


@query("c2_clean_cell", f"""
    WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, e'\\n'), lambda v: {norm('v')}),
                          lambda v: v NOT IN ('', 'none')) AS l FROM documents)
    SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, '|')) AS digest FROM lines""")
def c2_clean_cell(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", text.clean_list(F.split("text", "\n")).alias("l"))
    return df.selectExpr("doc_id", "cast(size(l) as bigint) as n_lines", "md5(array_join(l, '|')) as digest")


@query("c3_parse_nested_list", over_persons(
    f"SELECT id, array_to_string({parsed('telephones')}, '|') AS telephones FROM persons"))
def c3_parse_nested_list(spark: SparkSession, sf: str) -> DataFrame:
    return persons(spark, sf).select("id", F.array_join(text.parse_nested_list(F.col("telephones")), "|").alias("telephones"))


@query("c4_enrich_emails", over_clean("SELECT record_id, array_to_string(emails, '|') AS emails FROM clean"))
def c4_enrich_emails(spark: SparkSession, sf: str) -> DataFrame:
    mails = text.enrich_emails(text.parse_nested_list(F.col("emails")))
    return persons(spark, sf).select(F.col("id").alias("record_id"), F.array_join(mails, "|").alias("emails"))


@query("c5_normalize_birth_date", over_clean("SELECT record_id, birth_date FROM clean"))
def c5_normalize_birth_date(spark: SparkSession, sf: str) -> DataFrame:
    return persons(spark, sf).select(F.col("id").alias("record_id"), text.normalize_birth_date("birth_date").alias("birth_date"))


_WORDS = f"list_filter(list_transform(string_split(text, ' '), lambda v: {norm('v')}), lambda v: v <> '')"


@query("c6_unique_non_empty", f"""
    WITH w AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS l FROM conversations)
    SELECT conv_id, turn, len(l) AS n_words, md5(array_to_string(list_sort(l), '|')) AS digest FROM w""")
def c6_unique_non_empty(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", text.unique_non_empty(F.split("text", " ")).alias("l"))
    return df.selectExpr("conv_id", "turn", "cast(size(l) as bigint) as n_words", "md5(array_join(sort_array(l), '|')) as digest")


@query("c7_full_names", over_clean("""
    SELECT record_id, concat_ws('|', birth_family_name || ' ' || birth_first_name,
           CASE WHEN origin <> birth_first_name THEN birth_family_name || ' ' || origin END,
           sexy || ' ' || birth_first_name, CASE WHEN origin <> birth_first_name THEN sexy || ' ' || origin END) AS names
    FROM (SELECT *, CASE WHEN sex = '' OR sex = birth_family_name THEN NULL ELSE sex END AS sexy FROM clean)"""))
def c7_full_names(spark: SparkSession, sf: str) -> DataFrame:
    names = text.full_name_candidates([F.array("birth_family_name", "sex")], [F.array("birth_first_name", "origin")])
    return clean_persons(spark, sf).select("record_id", F.array_join(names, "|").alias("names"))


@query("c8_addresses", over_clean("""
    SELECT record_id, array_to_string(list_transform(emails, lambda e: concat_ws(' ', addresses_street[1], e, addresses_city[1],
           addresses_postal_code[1])), '|') AS addresses FROM clean"""))
def c8_addresses(spark: SparkSession, sf: str) -> DataFrame:
    # several complements per record: its e-mail spellings
    c = F.col
    spellings = text.address_candidates(c("addresses_street"), c("emails"), c("addresses_city"), c("addresses_postal_code"))
    return clean_persons(spark, sf).select("record_id", F.array_join(spellings, "|").alias("addresses"))


@query("c9_c11_casts", """
    SELECT o_orderkey, coalesce(try_cast(split_part(o_orderpriority, '-', 1) AS BIGINT), -1) AS level,
           CAST(-1 AS BIGINT) AS no_level, coalesce(try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE), 0) AS level_double,
           o_orderstatus AS status FROM orders""")
def c9_c11_casts(spark: SparkSession, sf: str) -> DataFrame:
    level = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    return table(spark, sf, "orders").select(
        "o_orderkey", text.safe_int(level, -1).alias("level"), text.safe_int(F.col("o_orderpriority"), -1).alias("no_level"),
        text.safe_float(level, 0.0).alias("level_double"), text.safe_str(F.col("o_orderstatus")).alias("status"))


@query("c12_remove_accents", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def c12_remove_accents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.remove_accents(F.col("text"))).alias("digest"))


@query("c13_normalize_no_accents", r"""
    SELECT page_id, md5(trim(regexp_replace(strip_accents(lower(html)), '\s+', ' ', 'g'))) AS digest FROM pages""")
def c13_normalize_no_accents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(text.normalize_no_accents(F.col("html"))).alias("digest"))


@query("c14_is_ascii", r"SELECT doc_id, strlen(text) = length(text) AS ascii FROM documents")
def c14_is_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.is_ascii(F.col("text")).alias("ascii"))


_SUBSTRINGS = ("the", "der", "eau", "###", "ción", "")


@query("c15_substrings", "SELECT doc_id, array_to_string(list_filter(["
       + ", ".join(f"'{s}'" for s in _SUBSTRINGS if s) + "], lambda s: contains(text, s)), ',') AS found FROM documents")
def c15_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.substrings_included(_SUBSTRINGS, F.col("text")), ",").alias("found"))


@query("c16_chunk_list", """
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents)
    SELECT doc_id, CAST(ceil(len(l) / 10.0) AS INT) AS n_chunks,
           array_to_string(list_slice(l, (len(l) - 1) // 10 * 10 + 1, len(l)), ' ') AS last_chunk FROM w""")
def c16_chunk_list(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("l"))
    df = df.select("doc_id", text.chunk_list(F.col("l"), 10).alias("chunks"))
    return df.selectExpr("doc_id", "size(chunks) as n_chunks", "array_join(element_at(chunks, -1), ' ') as last_chunk")


@query("c17_random_string", "SELECT c_custkey, 12 AS n_chars, true AS alphanumeric FROM customer")
def c17_random_string(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", text.random_string(12).alias("r"))
    return df.selectExpr("c_custkey", "length(r) as n_chars", "r rlike '^[a-zA-Z0-9]*$' as alphanumeric")


@query("c18_json_payload", "SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events")
def c18_json_payload(spark: SparkSession, sf: str) -> DataFrame:
    payload = text.parse_json_payload(F.encode("props", "UTF-8"), "k bigint")
    return table(spark, sf, "events").select("event_id", payload.alias("p")).select("event_id", "p.k")


@query("c19_age", over_clean("""
    SELECT record_id, CAST(round_even(date_diff('day', try_cast(birth_date AS DATE), DATE '2024-01-01') / 365.0, 0) AS INT) AS age
    FROM clean WHERE birth_date <> ''"""))
def c19_age(spark: SparkSession, sf: str) -> DataFrame:
    age = text.age_in_years(F.col("birth_date"), F.lit("2024-01-01").cast("date"))
    return clean_persons(spark, sf).filter("birth_date <> ''").select("record_id", age.cast("int").alias("age"))


@query("x2_cleaning_on_read", over_persons(
    "SELECT " + ", ".join(f"{norm(c)} AS {c}" for c in _PERSON_COLUMNS) + " FROM persons"))
def x2_cleaning_on_read(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "persons-csv")
    persons(spark, sf).write.option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path, cleaning_fn=text.normalize_text)
