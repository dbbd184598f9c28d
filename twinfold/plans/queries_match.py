"""Queries over similarities, scoring, clustering, linking, learning and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.config import FieldSpec, MatchConfig
from twinfold.functions import similarity as sim
from twinfold.functions.validate import valid_date_text
from twinfold.operators import blocking, cluster, learn, link, nearness, scoring
from twinfold.operators.blocking import rule
from twinfold.operators.clean import preprocess
from twinfold.operators.profile import run_counts, score_histogram
from twinfold.operators.ranking import with_row_index
from twinfold.plans import dedupe
from twinfold.plans.oracle import over_clean, over_clean_recursive, over_persons
from twinfold.plans.persons import BLOCKING, MODEL, clean_persons, persons, table
from twinfold.plans.queries_blocking import PERSON_KEYS, PERSON_PAIRS
from twinfold.plans.registry import query
from twinfold.sources import writers
from twinfold.sources.lineage import scratch_path, stored
from twinfold.sources.readers import read_csv
from twinfold.streaming import linkage

# ---- SQL of the similarities ---------------------------------------------------------------


def gotoh_sql(a: str, b: str) -> str:
    """Affine gap distance: a fold over the letters of ``a`` that carries one row of the table."""
    x = "least(prev[j + 1].d + 17, prev[j + 1].x + 7)"
    y = "least(acc[-1].d + 17, acc[-1].y + 7)"
    diagonal = f"prev[j].d + CASE WHEN substr({b}, j, 1) = c THEN 1 ELSE 11 END"
    first = "least(prev[1].d + 17, prev[1].x + 7)"
    big = "CAST(1000000000 AS BIGINT)"
    start = (f"list_transform(range(0, length({b}) + 1), lambda j: {{'d': CAST(CASE WHEN j = 0 THEN 0 ELSE 10 + 7 * j END "
             f"AS BIGINT), 'x': {big}, 'y': {big}}})")
    row = (f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, "
           f"{{'d': least({diagonal}, {x}, {y}), 'x': {x}, 'y': {y}}}), [{{'d': {first}, 'x': {first}, 'y': {big}}}])")
    table_ = f"list_reduce(string_split({a}, ''), lambda prev, c: {row}, {start})"
    return f"(({table_})[-1].d / (length({a}) + length({b})))"


def ratio_sql(a: str, b: str) -> str:
    row = (f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, greatest(prev[j + 1], acc[-1], "
           f"prev[j] + CASE WHEN substr({b}, j, 1) = c THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)])")
    start = f"list_transform(range(0, length({b}) + 1), lambda j: CAST(0 AS BIGINT))"
    lcs = f"(list_reduce(string_split({a}, ''), lambda prev, c: {row}, {start}))[-1]"
    return f"(200.0 * {lcs} / (length({a}) + length({b})))"


_FULL = "pairs JOIN clean l ON l.record_id = left_id JOIN clean r ON r.record_id = right_id"
_EDIT = "(1 - levenshtein(l.{0}, r.{0}) / greatest(length(l.{0}), length(r.{0})))"


def _all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Hydrated candidate pairs of the person blocking rules."""
    people = clean_persons(spark, sf)
    fields = ["birth_family_name", "birth_first_name", "birth_date", "sex", "emails", "telephones", "addresses_street"]
    return blocking.hydrate(blocking.candidate_pairs(people, BLOCKING), people, fields)


def _compare(name: str, sql: str, make) -> None:
    """A query of one similarity over all candidate pairs."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        value = make()
        return _all_pairs(spark, sf).select("left_id", "right_id", F.round(value, 6).alias("value"))

    query(name, over_clean(f"SELECT left_id, right_id, CAST(round({sql}, 6) AS DOUBLE) AS value FROM {_FULL}", PERSON_KEYS, PERSON_PAIRS))(run)


def _native(kind: str, field: str):
    return lambda: F.expr(sim.NATIVE[kind](f"l.{field}", f"r.{field}"))


_compare("g1_exact", "CASE WHEN l.birth_first_name = r.birth_first_name THEN 1.0 ELSE 0.0 END", _native("Exact", "birth_first_name"))
_compare("g2_affine_gap", gotoh_sql("l.birth_family_name", "r.birth_family_name"),
         lambda: sim.affine_gap()(F.col("l.birth_family_name"), F.col("r.birth_family_name")))
_compare("g3_short_string", gotoh_sql("l.birth_first_name", "r.birth_first_name"),
         lambda: sim.affine_gap()(F.col("l.birth_first_name"), F.col("r.birth_first_name")))
_compare("g4_date_distance", "sqrt(abs(date_diff('day', try_cast(l.birth_date AS DATE), try_cast(r.birth_date AS DATE))))",
         _native("DateTime", "birth_date"))
_compare("g6_ratio", ratio_sql("l.birth_family_name", "r.birth_family_name"),
         lambda: sim.ratio(F.col("l.birth_family_name"), F.col("r.birth_family_name")))
_compare("g10_edit_similarity", _EDIT.format("birth_family_name"), _native("Edit", "birth_family_name"))


def same_initial(left: Column, right: Column) -> Column:
    return (F.left(left, F.lit(1)) == F.left(right, F.lit(1))).cast("double")


@query("x1_custom_comparator", over_clean(f"""
    SELECT left_id, right_id, CASE WHEN left(l.birth_first_name, 1) = left(r.birth_first_name, 1) THEN 1.0::DOUBLE ELSE 0.0 END AS initial,
      CASE WHEN l.telephones = [] OR r.telephones = [] THEN 0.0::DOUBLE WHEN len(l.telephones) = len(r.telephones) THEN 1.0 ELSE 0.0 END AS as_many,
      CASE WHEN l.telephones = [] OR r.telephones = [] THEN 1.0::DOUBLE ELSE 0.0 END AS as_many__missing
    FROM {_FULL}""", PERSON_KEYS, PERSON_PAIRS))
def x1_custom_comparator(spark: SparkSession, sf: str) -> DataFrame:
    fields = (FieldSpec("birth_first_name", "Custom", False, name="initial", comparator=same_initial),
              FieldSpec("telephones", "Custom", True, name="as_many", comparator=lambda a, b: (F.size(a) == F.size(b)).cast("double")))
    return scoring.add_features(_all_pairs(spark, sf), fields).select("left_id", "right_id", *scoring.feature_names(fields))


@query("g5_lists_similar", over_clean(f"""
    SELECT left_id, right_id, CAST(max({ratio_sql('x', 'y')}) > 85 AS DOUBLE) AS value
    FROM (SELECT left_id, right_id, x, unnest(ys) AS y FROM (SELECT left_id, right_id, unnest(l.emails) AS x, r.emails AS ys FROM {_FULL}))
    GROUP BY 1, 2""", PERSON_KEYS, PERSON_PAIRS))
def g5_lists_similar(spark: SparkSession, sf: str) -> DataFrame:
    pairs = sim.with_near_items(_all_pairs(spark, sf), ["emails"])
    return pairs.select("left_id", "right_id", sim.lists_similar("emails").alias("value"))


_FEATURE_FIELDS = (
    FieldSpec("birth_family_name", "Edit", True, name="family"), FieldSpec("birth_first_name", "Edit", True, name="first"),
    FieldSpec("birth_date", "DateTime"), FieldSpec("telephones", "Overlap"),
    FieldSpec("combined_name", "Interaction", parts=("family", "first")),
)


@query("g7_g9_features", over_clean(f"""
    SELECT left_id, right_id, round({_EDIT.format('birth_family_name')}, 6) AS family, CAST(0 AS DOUBLE) AS family__missing,
      round({_EDIT.format('birth_first_name')}, 6) AS first, CAST(0 AS DOUBLE) AS first__missing,
      round(CASE WHEN l.birth_date = '' OR r.birth_date = '' THEN 0
                 ELSE sqrt(abs(date_diff('day', try_cast(l.birth_date AS DATE), try_cast(r.birth_date AS DATE)))) END, 6) AS birth_date,
      CAST(l.birth_date = '' OR r.birth_date = '' AS DOUBLE) AS birth_date__missing,
      CAST(list_has_any(l.telephones, r.telephones) AS DOUBLE) AS telephones,
      CAST(len(l.telephones) = 0 OR len(r.telephones) = 0 AS DOUBLE) AS telephones__missing,
      round({_EDIT.format('birth_family_name')} * {_EDIT.format('birth_first_name')}, 6) AS combined_name
    FROM {_FULL}""", PERSON_KEYS, PERSON_PAIRS))
def g7_g9_features(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.add_features(_all_pairs(spark, sf), _FEATURE_FIELDS)
    return out.select("left_id", "right_id", *(F.round(n, 6).alias(n) for n in scoring.feature_names(_FEATURE_FIELDS)))


# ---- scores --------------------------------------------------------------------------------

_SCORE = f"""1 / (1 + exp(-(-6.5 + 4 * {_EDIT.format('birth_family_name')}
      + CASE WHEN l.birth_family_name = r.birth_family_name THEN 2 ELSE 0 END + {_EDIT.format('birth_first_name')}
      + CASE WHEN list_has_any(l.emails, r.emails) THEN 4 ELSE 0 END
      + CASE WHEN len(l.telephones) = 0 OR len(r.telephones) = 0 THEN 0.6 WHEN list_has_any(l.telephones, r.telephones) THEN 2 ELSE 0 END
      + CASE WHEN l.birth_date = '' OR r.birth_date = '' THEN 0.6 WHEN l.birth_date = r.birth_date THEN 2 ELSE 0 END)))"""
SCORED = f"""scored AS (SELECT left_id, right_id, {_SCORE} AS score FROM {_FULL}), matches AS (SELECT * FROM scored WHERE score >= 0.5)"""
_SCORED_CTES = (PERSON_KEYS, PERSON_PAIRS, SCORED)
COMPONENTS = """edges AS (
  SELECT left_id AS a, right_id AS b FROM matches UNION ALL SELECT right_id, left_id FROM matches
), reach AS (
  SELECT record_id AS a, record_id AS b FROM clean UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), clusters AS (SELECT a AS record_id, min(b) AS cluster_id FROM reach GROUP BY a)"""
_CLUSTER_CTES = (*_SCORED_CTES, COMPONENTS)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_pairs(_all_pairs(spark, sf), MODEL).select("left_id", "right_id", "score")


@query("m3_scores", over_clean("SELECT left_id, right_id, round(score, 6) AS score FROM scored", *_SCORED_CTES))
def m3_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("m10_scored_pairs", over_clean("SELECT left_id, right_id, round(score, 6) AS score, score >= 0.65 AS is_duplicate FROM scored", *_SCORED_CTES))
def m10_scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.emit_pairs(_scored(spark, sf), 0.65).withColumn("score", F.round("score", 6))


@query("p18_matching_pairs", over_clean("SELECT left_id, right_id, round(score, 6) AS score FROM matches", *_SCORED_CTES))
def p18_matching_pairs(spark: SparkSession, sf: str) -> DataFrame:
    # same result as scoring every candidate, from far fewer pairs
    pairs = scoring.matching_pairs(clean_persons(spark, sf), BLOCKING, MODEL, 0.5)
    return pairs.withColumn("score", F.round("score", 6))


@query("a17_score_histogram", over_clean("""
    SELECT CAST(least(floor(score * 20), 19) + 1 AS INT) AS bin, count(*) AS count FROM scored GROUP BY 1""", *_SCORED_CTES))
def a17_score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return score_histogram(_scored(spark, sf), "score")


# ---- clusters ------------------------------------------------------------------------------


@query("l1_match_components", over_clean_recursive("SELECT record_id, cluster_id FROM clusters", *_CLUSTER_CTES))
def l1_match_components(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.match_components(clean_persons(spark, sf), MODEL, BLOCKING)


@query("a15_cluster_sizes", over_clean_recursive("""
    SELECT size, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1) GROUP BY 1""", *_CLUSTER_CTES))
def a15_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.size_distribution(l1_match_components(spark, sf))


@query("j4_w1_membership", over_clean_recursive("""
    SELECT p.id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM persons p
    LEFT JOIN clusters c ON c.record_id = p.id""", *_CLUSTER_CTES))
def j4_w1_membership(spark: SparkSession, sf: str) -> DataFrame:
    members = l1_match_components(spark, sf)
    joined = persons(spark, sf).select("id").join(members, F.col("id") == F.col("record_id"), "left")
    return cluster.with_cluster_size(joined).select("id", "cluster_id", "cluster_size")


# centroid linkage and confidence of components of up to three members, in closed form
_LINKED = f"""members AS (
  SELECT cluster_id AS c, record_id, row_number() OVER (PARTITION BY cluster_id ORDER BY record_id) AS n,
         count(*) OVER (PARTITION BY cluster_id) AS size FROM clusters
), distances AS (
  SELECT a.c, a.n AS i, b.n AS j, 1 - {_SCORE} AS d FROM members a JOIN members b ON a.c = b.c AND a.n < b.n
  JOIN clean l ON l.record_id = a.record_id JOIN clean r ON r.record_id = b.record_id
), shapes AS (
  SELECT c, max(d) FILTER (i = 1 AND j = 2) AS d12, max(d) FILTER (i = 1 AND j = 3) AS d13, max(d) FILTER (i = 2 AND j = 3) AS d23
  FROM distances GROUP BY c
), merged AS (
  SELECT *, least(d12, d13, d23) AS m, CASE WHEN d12 = least(d12, d13, d23) THEN 3 WHEN d13 = least(d12, d13, d23) THEN 2 ELSE 1 END AS odd,
    sqrt((d12 * d12 + d13 * d13 + d23 * d23 - least(d12, d13, d23) ** 2) / 2 - least(d12, d13, d23) ** 2 / 4) <= 0.5 AS whole
  FROM shapes
), linked AS (
  SELECT record_id,
    CASE WHEN size < 3 OR whole THEN v.c WHEN n = odd THEN record_id
         WHEN odd = 1 THEN (SELECT record_id FROM members x WHERE x.c = v.c AND x.n = 2) ELSE v.c END AS cluster_id,
    CASE WHEN size = 1 THEN 1 WHEN size = 2 THEN 1 - d12
         WHEN whole THEN 1 - sqrt(CASE n WHEN 1 THEN d12 * d12 + d13 * d13 WHEN 2 THEN d12 * d12 + d23 * d23 ELSE d13 * d13 + d23 * d23 END / 2)
         WHEN n = odd THEN 1 ELSE 1 - m END AS confidence_score
  FROM members v LEFT JOIN merged USING (c)
)"""
_LINKED_CTES = (*_CLUSTER_CTES, _LINKED)
_LINKED_SQL = over_clean_recursive("SELECT record_id, cluster_id, round(confidence_score, 6) AS confidence_score FROM linked", *_LINKED_CTES)


@query("l5_clusters", _LINKED_SQL)
def l5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    members = dedupe.get_clusters(clean_persons(spark, sf), MODEL, BLOCKING)
    return members.withColumn("confidence_score", F.round("confidence_score", 6))


@query("l6_dataset_deduplication", _LINKED_SQL)
def l6_dataset_deduplication(spark: SparkSession, sf: str) -> DataFrame:
    membership, _ = dedupe.run("datasetDeduplicationCluster", persons(spark, sf), MODEL, BLOCKING)
    return membership.withColumn("confidence_score", F.round("confidence_score", 6))


@query("l2_long_chain", """
    SELECT c_custkey AS record_id, c_custkey - CASE WHEN c_custkey % 2 = 0 AND c_custkey > 0 THEN 1 ELSE 0 END AS cluster_id,
      CASE WHEN c_custkey = 0 OR c_custkey % 2 = 1 AND c_custkey = (SELECT max(c_custkey) FROM customer) THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence_score
    FROM customer""")
def l2_long_chain(spark: SparkSession, sf: str) -> DataFrame:
    # one component of the whole table: every customer matches the next, each second time better
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("record_id"))
    score = F.when(F.col("record_id") % 2 == 1, 0.9).otherwise(0.7)
    edges = (ids.join(ids.select((F.col("record_id") - 1).alias("record_id")), "record_id")
             .select(F.col("record_id").alias("left_id"), (F.col("record_id") + 1).alias("right_id"), score.alias("score")))
    items = ids.select("record_id", F.lit(1).alias("copies"), F.lit(1.0).alias("own"))
    return cluster.agglomerate(items, edges, 0.5).withColumn("confidence_score", F.round("confidence_score", 6))


_EXPORT = """FROM persons p LEFT JOIN linked c ON c.record_id = p.id"""
_EXPORT_ORDER = "row_number() OVER (ORDER BY cluster_id NULLS LAST, p.id) - 1 AS place"


@query("p7_o2_non_sensitive", over_clean_recursive(f"""
    SELECT {_EXPORT_ORDER}, cluster_id, round(confidence_score, 6) AS confidence_score, count(*) OVER (PARTITION BY cluster_id) AS cluster_size,
           p.id, p.origin, p.birth_family_name, p.birth_first_name {_EXPORT}""", *_LINKED_CTES))
def p7_o2_non_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    rows = writers.export_frame(persons(spark, sf), l5_clusters(spark, sf), keep_columns=MatchConfig().non_sensitive_columns)
    return with_row_index(rows).withColumnRenamed("__index", "place")


@query("s6_cluster_export", over_clean_recursive(f"""
    SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, round(confidence_score, 6) AS confidence_score,
           CAST(count(*) OVER (PARTITION BY cluster_id) AS VARCHAR) AS cluster_size,
           CAST(p.id AS VARCHAR) AS id, p.origin, p.birth_family_name, p.birth_first_name {_EXPORT}""", *_LINKED_CTES))
def s6_cluster_export(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "export")
    writers.write_clusters(persons(spark, sf), l5_clusters(spark, sf), path, keep_columns=MatchConfig().non_sensitive_columns)
    return read_csv(spark, path).selectExpr("cluster_id", "cast(confidence_score as double) as confidence_score", "cluster_size", "id", "origin",
                                            "birth_family_name", "birth_first_name")


@query("a13_confidence_histogram", over_clean_recursive("""
    SELECT CAST(least(floor(round(confidence_score, 6) * 20), 19) + 1 AS INT) AS bin, count(*) AS count FROM linked GROUP BY 1""", *_LINKED_CTES))
def a13_confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return score_histogram(l5_clusters(spark, sf), "confidence_score")


@query("a18_run_counts", over_clean("""
    SELECT (SELECT count(*) FROM persons) AS records_count,
      CAST((SELECT count(*) FROM (SELECT unnest(json_keys(to_json(p))) FROM (SELECT p FROM persons p LIMIT 1))) AS INT) AS columns_count, (SELECT count(*) FROM matches) AS matches_found""", *_SCORED_CTES))
def a18_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf)
    return run_counts(persons(spark, sf),
                      scoring.matching_pairs(people, BLOCKING, MODEL, 0.5))


# ---- linkage -------------------------------------------------------------------------------

# every person arrives as a new record under a negative id and is linked to the whole table
_LINK_CTES = (
    PERSON_KEYS,
    """pairs AS (SELECT DISTINCT a.record_id AS left_id, b.record_id AS right_id FROM block_keys a JOIN block_keys b
       ON a.rule = b.rule AND a.k = b.k)""",
    SCORED,
)
_LINK_SQL = over_clean("SELECT -1 - left_id AS query_id, right_id AS record_id, round(score, 6) AS confidence_score FROM matches",
                       *_LINK_CTES)
_RANKED_SQL = over_clean("""
    SELECT query_id, record_id, confidence_score, row_number() OVER (ORDER BY confidence_score DESC, query_id, record_id) - 1 AS place
    FROM (SELECT -1 - left_id AS query_id, right_id AS record_id, round(score, 6) AS confidence_score FROM matches)""", *_LINK_CTES)


@query("j2_o1_linkage", _RANKED_SQL)
def j2_o1_linkage(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf)
    links = link.link_records(people.withColumn("record_id", -1 - F.col("record_id")), people, BLOCKING, MODEL)
    ranked = link.ranked_links(links.withColumn("confidence_score", F.round("confidence_score", 6)))
    return with_row_index(ranked).withColumnRenamed("__index", "place")


@query("t1_streaming_linkage", _LINK_SQL)
def t1_streaming_linkage(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["record_id", *MODEL.columns]
    base_path, in_path = scratch_path(spark, "base"), scratch_path(spark, "arriving")
    people = persons(spark, sf)
    clean_persons(spark, sf).select(*columns).write.parquet(base_path)
    people.write.parquet(in_path)
    arriving = spark.readStream.schema(people.schema).parquet(in_path)
    records = preprocess(arriving).withColumn("record_id", -1 - F.col("id").cast("bigint")).select(*columns)
    out = scratch_path(spark, "links")
    linkage.link_stream(records, spark.read.parquet(base_path), BLOCKING, MODEL, out,
                        scratch_path(spark, "offsets"), available_now=True).awaitTermination()
    return spark.read.parquet(out).selectExpr("query_id", "record_id", "round(confidence_score, 6) as confidence_score")


@query("t2_streaming_cleaning", over_persons(r"""
    SELECT id, lower(trim(strip_accents(birth_family_name))) AS birth_family_name,
           CASE WHEN regexp_matches(birth_date, '^\d{4}-\d{2}-\d{2}$') THEN '' ELSE 'birth_date' END AS errors FROM persons"""))
def t2_streaming_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    in_path, out = scratch_path(spark, "arriving"), scratch_path(spark, "cleaned")
    people = persons(spark, sf)
    people.write.parquet(in_path)
    arriving = spark.readStream.schema(people.schema).parquet(in_path)
    cleaned = linkage.clean_stream(arriving, {"birth_date": valid_date_text(F.col("birth_date"))})
    linkage.write_parquet_now(cleaned, out, scratch_path(spark, "offsets"))
    return spark.read.parquet(out).selectExpr("cast(id as bigint) as id", "birth_family_name", "array_join(errors, ',') as errors")


@query("t3_streaming_duplicates", """
    SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events""")
def t3_streaming_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    # the events arrive in four files, one to a micro-batch, in no order of time
    arriving, out = scratch_path(spark, "events"), scratch_path(spark, "distinct-events")
    keys = ["user_id", "event_type", "day"]
    events = table(spark, sf, "events").selectExpr("user_id", "event_type", "cast(ts as date) as day")
    events.repartition(4, F.xxhash64(*keys, F.rand(1))).write.parquet(arriving)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    linkage.write_distinct(stream, keys, out, scratch_path(spark, "offsets"), available_now=True).awaitTermination()
    return spark.read.parquet(out).select(*keys)


# ---- learning ------------------------------------------------------------------------------

_TRUTH = """truth AS (SELECT a.record_id AS left_id, b.record_id AS right_id FROM clean a JOIN clean b
  ON a.entity_id = b.entity_id AND a.record_id < b.record_id)"""


def true_pairs(people: DataFrame) -> DataFrame:
    keyed = people.withColumn("entity", F.col("entity_id").cast("string"))
    return blocking.candidate_pairs(keyed, [rule(("whole_field", "entity"))])


def person_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on all candidates and on each first copy with the next entity's, taken from the entity of each record."""
    people = clean_persons(spark, sf).select("record_id", "entity_id", *MODEL.columns)
    first = people.filter("record_id % 10 = 0").select("record_id")
    others = (first.join(first.selectExpr("record_id - 10 as record_id"), "record_id")
              .selectExpr("record_id as left_id", "record_id + 10 as right_id"))
    pairs = blocking.candidate_pairs(people, BLOCKING).union(others).distinct()
    return blocking.hydrate(pairs, people, ["entity_id"]).selectExpr(
        "left_id", "right_id", "cast(l.entity_id = r.entity_id as int) as label")


_LABELS = """labelled AS (SELECT left_id, right_id, CAST(l.entity_id = r.entity_id AS INT) AS label
  FROM (SELECT left_id, right_id FROM pairs UNION SELECT a.record_id, b.record_id FROM clean a JOIN clean b
        ON a.record_id % 10 = 0 AND b.record_id = a.record_id + 10) p JOIN clean l ON l.record_id = left_id JOIN clean r ON r.record_id = right_id)"""


@query("m1_training_sample", over_clean("""
    SELECT s.left_id, s.right_id, l.label FROM (SELECT left_id, right_id FROM labelled
      ORDER BY md5(concat_ws(':', 0, left_id, right_id)), left_id, right_id LIMIT 500) s
    LEFT JOIN (SELECT * FROM labelled WHERE label = 1) l ON l.left_id = s.left_id AND l.right_id = s.right_id
    UNION SELECT left_id, right_id, label FROM labelled WHERE label = 1""", PERSON_KEYS, PERSON_PAIRS, _LABELS))
def m1_training_sample(spark: SparkSession, sf: str) -> DataFrame:
    labels = person_labels(spark, sf)
    return learn.prepare_training(labels, 500, labels.filter("label = 1"))


@query("s7_s8_labels", over_clean("SELECT left_id, right_id, label FROM labelled", PERSON_KEYS, PERSON_PAIRS, _LABELS))
def s7_s8_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    writers.save_labels(person_labels(spark, sf), path)
    return writers.load_labels(spark, path)


@query("m4_uncertain_pairs", over_clean("""
    SELECT left_id, right_id, round(score, 6) AS score FROM scored ORDER BY abs(round(score, 9) - 0.5), left_id, right_id LIMIT 25""", *_SCORED_CTES))
def m4_uncertain_pairs(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf).withColumn("score", F.round("score", 9))
    return learn.uncertain_pairs(scored, 25).withColumn("score", F.round("score", 6))


@query("m5_applied_labels", over_clean("SELECT left_id, right_id, 1 - label AS label FROM labelled",
                                       PERSON_KEYS, PERSON_PAIRS, _LABELS))
def m5_applied_labels(spark: SparkSession, sf: str) -> DataFrame:
    # every verdict is later reversed
    stored = person_labels(spark, sf).withColumn("ts", F.lit(1))
    return learn.apply_labels(stored, stored.withColumns({"label": 1 - F.col("label"), "ts": F.lit(2)}))


@query("m9_evaluation", over_clean("""
    SELECT round(h / f, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (f + t), 6) AS f1_score, f AS duplicates_found
    FROM (SELECT (SELECT count(*) FROM matches JOIN truth USING (left_id, right_id)) AS h,
                 (SELECT count(*) FROM matches) AS f, (SELECT count(*) FROM truth) AS t)""", *_SCORED_CTES, _TRUTH))
def m9_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf)
    found = scoring.matching_pairs(people, BLOCKING, MODEL, 0.5)
    return learn.evaluate(found, true_pairs(people)).selectExpr(
        "round(precision, 6) as precision", "round(recall, 6) as recall", "round(f1_score, 6) as f1_score", "duplicates_found")


TRAINING_FIELDS = (
    FieldSpec("birth_family_name", "String", False), FieldSpec("birth_first_name", "String", False),
    FieldSpec("birth_date", "Exact"), FieldSpec("emails", "Overlap", False), FieldSpec("telephones", "Overlap"),
)
CANDIDATE_RULES = (*BLOCKING, rule(("whole_field", "birth_date")), rule(("double_metaphone", "birth_family_name"), ("whole_field", "birth_first_name")),
                   rule(("fingerprint", "birth_family_name")), rule(("common_set_element", "telephones")))


@query("m2_trained_weights", over_clean("""
    SELECT label, count(*) AS pairs, CASE WHEN label = 1 THEN count(*) ELSE 0 END AS predicted FROM labelled GROUP BY 1""", PERSON_KEYS, PERSON_PAIRS, _LABELS))
def m2_trained_weights(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf)
    columns = ["birth_family_name", "birth_first_name", "birth_date", "emails", "telephones"]
    labelled = blocking.hydrate(person_labels(spark, sf), people, columns)
    _, fitted = learn.train(scoring.add_features(labelled, TRAINING_FIELDS), TRAINING_FIELDS)
    scored = fitted.transform(scoring.add_features(labelled, TRAINING_FIELDS))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("prediction") == 1).alias("predicted"))


_COVERS = """covered AS (SELECT left_id, right_id, list_filter([
    CASE WHEN l.birth_family_name = r.birth_family_name THEN 0 END, CASE WHEN list_has_any(l.emails, r.emails) THEN 1 END,
    CASE WHEN left(l.birth_family_name, 7) = left(r.birth_family_name, 7) AND l.birth_date = r.birth_date AND l.birth_date <> '' THEN 2 END],
    lambda x: x IS NOT NULL) AS covers
  FROM labelled JOIN clean l ON l.record_id = left_id JOIN clean r ON r.record_id = right_id WHERE label = 1)"""


@query("m6_predicate_coverage", over_clean("SELECT left_id, right_id, array_to_string(covers, ',') AS covers FROM covered",
                                           PERSON_KEYS, PERSON_PAIRS, _LABELS, _COVERS))
def m6_predicate_coverage(spark: SparkSession, sf: str) -> DataFrame:
    covered = learn.predicate_coverage(clean_persons(spark, sf), person_labels(spark, sf), BLOCKING)
    return covered.withColumn("covers", F.array_join("covers", ","))


# the greedy choice is made by hand: the rule of most matches a comparison, then whether any match is left
@query("m6_learned_predicates", over_clean("""
    SELECT rule, predicate, field FROM (VALUES (0, 'whole_field', 'birth_family_name'), (1, 'common_set_element', 'emails'),
      (2, 'same_seven_char_start', 'birth_family_name'), (2, 'whole_field', 'birth_date')) a(rule, predicate, field)
    WHERE rule IN (SELECT first FROM gains)
       OR rule IN (SELECT u FROM (SELECT c.u, count(*) / (1 + any_value(g.cost)) AS gain FROM (
              SELECT unnest(covers) AS u FROM covered WHERE NOT list_contains(covers, (SELECT first FROM gains))) c
            JOIN costs g ON g.rule = c.u GROUP BY c.u) ORDER BY gain DESC, u LIMIT 1)""", PERSON_KEYS, PERSON_PAIRS, _LABELS, _COVERS, """
    costs AS (SELECT rule, sum(n * (n - 1) / 2) AS cost FROM (SELECT rule, k, count(*) AS n FROM block_keys GROUP BY 1, 2) GROUP BY 1),
    gains AS (SELECT u AS first FROM (SELECT c.u, count(*) / (1 + any_value(g.cost)) AS gain FROM (SELECT unnest(covers) AS u FROM covered) c
      JOIN costs g ON g.rule = c.u GROUP BY c.u) ORDER BY gain DESC, u LIMIT 1)"""))
def m6_learned_predicates(spark: SparkSession, sf: str) -> DataFrame:
    chosen = learn.learn_predicates(clean_persons(spark, sf), person_labels(spark, sf), BLOCKING)
    atoms = [(BLOCKING.index(r), p, f) for r in chosen for p, f in sorted(r)]
    return spark.createDataFrame(atoms, "rule int, predicate string, field string")


@query("m7_s10_models_info", over_clean("""
    SELECT 1 AS model_id, (SELECT count(*) FROM labelled) AS n_labels, (SELECT count(*) FROM labelled WHERE label = 1) AS n_match,
      feature, true AS has_weight
    FROM (VALUES ('(bias)'), ('birth_family_name'), ('birth_first_name'), ('birth_date'), ('birth_date__missing'), ('emails'),
          ('telephones'), ('telephones__missing')) f(feature)""", PERSON_KEYS, PERSON_PAIRS, _LABELS))
def m7_s10_models_info(spark: SparkSession, sf: str) -> DataFrame:
    people = clean_persons(spark, sf).select("record_id", "birth_first_name", *MODEL.columns[:1], "birth_date", "emails", "telephones")
    path = scratch_path(spark, "model")
    dedupe.run("trainModel", path, people, person_labels(spark, sf), TRAINING_FIELDS, CANDIDATE_RULES)
    info = dedupe.run("getModelsInfo", spark, {1: path})
    return info.select("model_id", "n_labels", "n_match", "feature", F.col("weight").isNotNull().alias("has_weight"))


# ---- near agreement ------------------------------------------------------------------------

NAME_CUTOFF = 1.3


def _near_sql(values: str, lengths: str, edits: str, near: str) -> str:
    """All pairs of distinct values, those that lengths and edit distance rule out left out first."""
    return over_clean(f"""
        SELECT a, b FROM (SELECT x.v AS a, y.v AS b FROM v x JOIN v y ON x.v < y.v AND {lengths} AND levenshtein(x.v, y.v) <= {edits}) WHERE {near}""",
                      f"v AS (SELECT DISTINCT v FROM (SELECT {values} AS v FROM clean) WHERE v <> '')")


# what a near pair may cost beyond matches is 0.8 a letter, and an edit costs 6.5 or more
@query("g2_near_names", _near_sql("birth_family_name", "true", "0.123 * (length(x.v) + length(y.v))", f"{gotoh_sql('a', 'b')} <= {NAME_CUTOFF}"))
def g2_near_names(spark: SparkSession, sf: str) -> DataFrame:
    return nearness.near_pairs(nearness.field_values(clean_persons(spark, sf), "birth_family_name"), nearness.Nearness(NAME_CUTOFF))


@query("g5_near_items", _near_sql("unnest(emails)", "length(x.v) BETWEEN 0.73 * length(y.v) AND length(y.v) / 0.73",
                                  "0.15 * (length(x.v) + length(y.v))", f"{ratio_sql('a', 'b')} > 85"))
def g5_near_items(spark: SparkSession, sf: str) -> DataFrame:
    return nearness.near_pairs(nearness.field_values(clean_persons(spark, sf), "emails"), nearness.Nearness())


# ---- from labels to clusters and links ------------------------------------------------------

LEARNED_FIELDS = ("sex", "birth_first_name", "birth_family_name", "birth_date", "emails", "telephones", "combined_full_name_birth")
LEARNED = MatchConfig(fields=tuple(s for s in MatchConfig().fields if s.feature in LEARNED_FIELDS))


def configured_labels(records: DataFrame) -> DataFrame:
    """``left_id, right_id, label``: pairs of a twenty-fourth of the persons, with their other copies and with other persons."""
    ids = records.select("record_id", F.floor(F.col("record_id") / 10).alias("person"))
    some = ids.filter("person % 24 = 0").select(F.col("record_id").alias("x"), "person")
    others = some.withColumn("person", F.explode(F.array(*(F.col("person") + 12 * j for j in range(4)))))
    both = others.join(ids.select(F.col("record_id").alias("y"), "person"), "person").filter("x <> y")
    hard = learn.prepare_training(blocking.candidate_pairs(records, [rule(("whole_field", "birth_first_name"))]), 600)
    pairs = both.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).union(hard.select("left_id", "right_id")).distinct()
    return pairs.withColumn("label", (F.floor(F.col("left_id") / 10) == F.floor(F.col("right_id") / 10)).cast("int"))


@query("m8_learned_clusters")
def m8_learned_clusters(spark: SparkSession, sf: str) -> DataFrame:
    # text, date and list fields of the configuration: labels -> predicates and weights -> clusters
    people = persons(spark, sf)
    labels = stored(configured_labels(dedupe.prepare(people, LEARNED)), "labels")
    membership, _ = dedupe.run("datasetDeduplicationCluster", people, config=LEARNED, labels=labels, model_path=scratch_path(spark, "model"))
    return membership.withColumn("confidence_score", F.round("confidence_score", 6))
