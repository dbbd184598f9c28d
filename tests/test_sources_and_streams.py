"""Readers, writers, cleaning of whole tables, profiling edge cases and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from twinfold.config import MatchConfig
from twinfold.operators import clean, profile, ranking
from twinfold.plans.persons import BLOCKING, MODEL, clean_persons, persons
from twinfold.sources import readers, writers
from twinfold.sources.lineage import checkpoint_dir
from twinfold.streaming import linkage

from conftest import SF_DIR


def test_csv_keeps_quoted_lines_and_blanks(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,name,emails\n1,"Two\nlines ""q""",a@b.c@@@d@e.f\n2,,\n', encoding="utf-8")
    rows = readers.read_dataset(spark, str(tmp_path / "p.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'Two\nlines "q"', "a@b.c@@@d@e.f"), ("2", "", "")]
    upper = readers.read_csv(spark, str(tmp_path / "p.csv"), cleaning_fn=F.upper).filter("id = 1").first()
    assert upper.emails == "A@B.C@@@D@E.F"
    (tmp_path / "l.csv").write_bytes("id,name\n1,é\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first().name == "é"


@pytest.mark.parametrize("content", [[{"id": 1, "a": "x"}, {"id": 2}], {"records": [{"id": 1, "a": "x"}, {"id": 2}]}])
def test_json_shapes(spark, tmp_path, content):
    (tmp_path / "p.json").write_text(json.dumps(content))
    rows = readers.read_dataset(spark, str(tmp_path / "p.json")).orderBy("id").collect()
    assert [(r.id, r.a) for r in rows] == [(1, "x"), (2, None)]


def test_reader_errors(spark, tmp_path):
    (tmp_path / "p.json").write_text("not json")
    (tmp_path / "q.json").write_text('{"records": 3}')
    for name in ("p.json", "q.json", "p.xlsx"):
        with pytest.raises(ValueError):
            readers.read_dataset(spark, str(tmp_path / name))
    with pytest.raises(ValueError):
        readers.read_dataset(spark, f"{SF_DIR}/region.parquet", limit=0)
    assert readers.read_dataset(spark, f"{SF_DIR}/customer.parquet", limit=7).count() == 7


def test_base64_quarantine(spark):
    df = spark.createDataFrame([(1, base64.b64encode("é\n".encode()).decode()), (2, "%%"), (3, None)], "id int, content string")
    good, bad = readers.decode_base64_files(df, "content")
    assert [(r.id, r.text) for r in good.collect()] == [(1, "é\n")] and {r.id for r in bad.collect()} == {2, 3}


def test_export_keeps_rows_without_id(spark, tmp_path):
    records = spark.createDataFrame([("1", "a", "s"), ("2", "b", "s"), ("x", "c", "s"), ("", "d", "s")], "id string, origin string, secret string")
    members = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.8)], "record_id long, cluster_id long, confidence_score double")
    writers.write_clusters(records, members, str(tmp_path / "out"), keep_columns=["id", "origin"])
    got = readers.read_csv(spark, str(tmp_path / "out"))
    assert "secret" not in got.columns
    assert {(r.origin, r.cluster_id, r.cluster_size) for r in got.collect()} == {("a", "1", "2"), ("b", "1", "2"), ("c", "", ""), ("d", "", "")}


def test_preprocess_types_and_missing_columns(spark):
    df = spark.createDataFrame([(7, None, ["A@B.C", "none"])], "id int, sex string, emails array<string>")
    row = clean.preprocess(df).first()
    assert row.id == "7" and row.sex == "" and row.emails == ["a@b.c", "a"]
    assert row.telephones == [] and row.addresses_street == []
    full = clean.add_candidates(clean.preprocess(df)).first()
    assert full.all_full_names == [] and full.all_addresses == []


def test_record_ids_never_collide(spark):
    rows = [("5",), ("1.0",), ("",), ("9",), ("abc",), (None,)]
    got = clean.with_record_id(spark.createDataFrame(rows, "id string").repartition(3), "id").collect()
    ids = sorted(r.record_id for r in got)
    assert ids == [5, 9, 10, 11, 12, 13]
    assert {r.record_id for r in got if r.id in ("5", "9")} == {5, 9}
    same = spark.createDataFrame([(1,), (1,), (2,)], "record_id long")
    assert [tuple(r) for r in clean.repeated_ids(same).collect()] == [(1, 2)]


def test_empty_dataset(spark):
    empty = spark.createDataFrame([], "a string, b double")
    with pytest.raises(ValueError):
        clean.require_rows(empty)
    assert {r.Null_values for r in profile.null_percentages(empty).collect()} == {0.0}
    assert profile.describe(empty).count() == 2


def test_running_totals_match_a_window(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7) % 13 as w").repartition(5)
    got = {r.id: r["__before"] for r in ranking.with_running_total(df, ["id"], "w").collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i * 7 % 13
    index = ranking.with_row_index(df, [F.desc("id")]).collect()
    assert all(r["__index"] == 999 - r.id for r in index)


def test_describe_small(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 4.0), ("b", None)], "s string, x double")
    rows = {r.Column_name: r for r in profile.describe(df).collect()}
    assert (rows["s"]["unique"], rows["s"].top, rows["s"].freq) == (2, "a", 2)
    assert (rows["x"]["count"], rows["x"].p25, rows["x"].p50, rows["x"].p75) == (3, 1.5, 2.0, 3.0)
    approx = profile.unique_values(df, approximate=True).collect()
    assert {r.Column_name: r.Unique_values for r in approx} == {"s": 2, "x": 3}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir").split(":")[-1] in checkpoint_dir(spark)


def test_streams_equal_batch(spark, tmp_path):
    people = persons(spark, SF_DIR)
    cleaned = clean_persons(spark, SF_DIR).select("record_id", *MODEL.columns)
    cleaned.write.parquet(str(tmp_path / "base"))
    cleaned.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(cleaned.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = spark.read.parquet(str(tmp_path / "base"))
    linkage.link_stream(arriving, base, BLOCKING, MODEL, str(tmp_path / "out"), str(tmp_path / "ck"),
                        available_now=True).awaitTermination()
    from twinfold.operators.link import link_records

    as_set = lambda df: {(r.query_id, r.record_id, round(r.confidence_score, 9)) for r in df.collect()}
    assert as_set(spark.read.parquet(str(tmp_path / "out"))) == as_set(link_records(cleaned, base, BLOCKING, MODEL))


def test_late_and_repeated_rows_of_a_stream(spark, tmp_path):
    """Several files, one to a micro-batch, days out of order, with nulls: as many rows as the batch result has."""
    rows = spark.range(400).selectExpr("if(id % 7 = 0, null, id % 11) as k", "date_sub(date'2024-06-01', cast(id % 13 as int)) as day", "id")
    rows.unionByName(rows).repartition(4).write.parquet(str(tmp_path / "dup"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "dup"))
    linkage.write_distinct(stream, ["k", "day"], str(tmp_path / "single"), str(tmp_path / "ck2"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "single"))
    assert got.count() == rows.select("k", "day").distinct().count() == got.select("k", "day").distinct().count()


def test_repetitions_are_known_after_a_restart(spark, tmp_path):
    """The state says what was seen: neither earlier output nor earlier input is read again."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.range(300).selectExpr("if(id % 9 = 0, null, id % 40) as k", "id as n")
    rows.filter("n < 200").repartition(3).write.parquet(source)

    def run(to):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = linkage.write_distinct(stream, ["k"], to, state, available_now=True)
        query.awaitTermination()

    run(out)
    first = spark.read.parquet(out).count()
    more = spark.range(3).selectExpr("id * 500 as k", "id as n").union(rows.filter("n >= 200"))
    more.write.mode("append").parquet(source)
    run(str(tmp_path / "other"))  # the earlier output is out of its reach
    assert first == rows.filter("n < 200").select("k").distinct().count()
    seen = spark.read.parquet(*(str(f) for f in tmp_path.glob("o*/part-*.parquet")))
    assert seen.count() == seen.select("k").distinct().count() == rows.union(more).select("k").distinct().count()


def test_late_rows_and_forgotten_keys(spark, tmp_path):
    source = str(tmp_path / "timed")

    def arrive(k, hour):
        spark.sql(f"select '{k}' as k, timestamp'2024-01-01 00:00:00' + interval {hour} hours as at").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, at timestamp").parquet(source)
        linkage.write_distinct(stream, ["k"], str(tmp_path / "once"), str(tmp_path / "held"), True, "at", "2 hours").awaitTermination()

    for k, hour in (("a", 0), ("a", 1), ("b", 10), ("a", 11), ("late", 1), ("b", 11)):
        arrive(k, hour)
    got = sorted((r.k, r["at"].hour) for r in spark.read.parquet(str(tmp_path / "once")).collect())
    assert got == [("a", 0), ("a", 11), ("b", 10)]
    with pytest.raises(ValueError):
        linkage.distinct_stream(spark.readStream.schema("k string").parquet(source), ["k"], delay="1 hour")
