"""Blocking, scoring, clustering and linking against brute force on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from twinfold.config import FieldSpec, MatchConfig, load_config, select_fields
from twinfold.operators import blocking, cluster, learn, link, scoring
from twinfold.operators.blocking import rule
from twinfold.operators.scoring import MatchModel
from twinfold.plans import dedupe
from twinfold.plans.persons import BLOCKING, MODEL, clean_persons
from twinfold.plans.queries_match import person_labels

from conftest import SF_DIR


def pairs_of(df):
    return sorted((r[0], r[1]) for r in df.select("left_id", "right_id").collect())


@pytest.mark.parametrize("max_block", [1, 3, 1000])
def test_hot_blocks_lose_no_pair(spark, max_block):
    rng = random.Random(1)
    # one key holds most of the rows
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", f"c{rng.randrange(3)}") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, a string, b string")
    rules = [rule(("whole_field", "a")), rule(("whole_field", "b"), ("same_three_char_start", "a"))]
    want = sorted((x[0], y[0]) for x, y in itertools.combinations(rows, 2)
                  if x[1] == y[1] or (x[2] == y[2] and x[1][:3] == y[1][:3]))
    assert pairs_of(blocking.candidate_pairs(df, rules, max_block=max_block)) == want
    carried = blocking.candidate_pairs(df, rules, payload=["a", "b"], max_block=max_block)
    values = {r[0]: (r[1], r[2]) for r in rows}
    for r in carried.collect():
        assert (tuple(r.l), tuple(r.r)) == (values[r.left_id], values[r.right_id])
    assert pairs_of(carried.distinct()) == want
    new, base = df.filter("record_id < 10"), df.filter("record_id >= 10")
    index = blocking.index_base(base, rules[:1], ["a"], max_block=max_block, keep=max_block == 3)
    crossed = blocking.cross_candidates(new, index, rules[:1], ["a"]).selectExpr(
        "query_id as left_id", "record_id as right_id")
    assert pairs_of(crossed) == [p for p in sorted((x[0], y[0]) for x in rows[:10] for y in rows[10:] if x[1] == y[1])]


def test_simplify_absorbs_rules():
    short, long_ = rule(("whole_field", "a")), rule(("whole_field", "a"), ("whole_field", "b"))
    assert blocking.simplify([long_, short]) == [short]
    assert blocking.simplify([rule(("whole_field", "a"), ("same_five_char_start", "a"))]) == [short]


@pytest.mark.parametrize("seed", range(4))
def test_tightened_rules_find_every_match(spark, seed):
    rng = random.Random(seed)
    rows = [(i, *(rng.choice(["", "x", "y", "z"]) for _ in range(3)), [rng.choice("pqrs") for _ in range(rng.randint(0, 2))])
            for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, a string, b string, c string, e array<string>")
    fields = (FieldSpec("a", "Exact"), FieldSpec("b", "Exact", False), FieldSpec("c", "Edit"), FieldSpec("e", "Overlap"),
              FieldSpec("ab", "Interaction", parts=("a", "b")))
    names = scoring.feature_names(fields)
    model = MatchModel(fields, {n: round(rng.uniform(-1, 3), 2) for n in names}, round(rng.uniform(-5, -2), 2))
    rules = [rule(("whole_field", "a")), rule(("common_set_element", "e"))]
    threshold = rng.choice([0.3, 0.5, 0.8])
    full = blocking.hydrate(blocking.candidate_pairs(df, rules), df, model.columns)
    want = pairs_of(scoring.keep_matches(scoring.score_pairs(full, model), threshold))
    assert pairs_of(scoring.matching_pairs(df, rules, model, threshold)) == want


def test_person_rules_use_no_wide_block_alone():
    rules = scoring.matching_rules(BLOCKING, MODEL, 0.5)
    assert rule(("same_seven_char_start", "birth_family_name")) not in rules and len(rules) == 3
    assert scoring.matching_rules(BLOCKING, MODEL, 1.0) == []


def test_features_mark_missing_values(spark):
    df = spark.createDataFrame([(1, 2, ("", [], "bad"), ("x", ["p"], "2000-01-01"))],
                               "left_id long, right_id long, l struct<a:string,e:array<string>,d:string>, r struct<a:string,e:array<string>,d:string>")
    out = scoring.add_features(df, (FieldSpec("a", "Exact"), FieldSpec("e", "Custom"), FieldSpec("d", "DateTime"),
                                    FieldSpec("t", "Interaction", parts=("a", "e")))).first()
    assert (out.a, out.e, out.d, out.t) == (0.0, 0.0, 0.0, 0.0)
    assert (out.a__missing, out.e__missing, out.d__missing) == (1.0, 1.0, 1.0)


@pytest.mark.parametrize("seed", range(3))
def test_components_agree_with_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}
    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.record_id: r.component for r in cluster.connected_components(
        spark.createDataFrame(edges, "left_id long, right_id long")).collect()}
    assert got == {n: root(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}


def clusters_by_definition(weight, scores, threshold, edges=None):
    """Centroid linkage from full distance matrices: mean squared distance between members minus both variances."""
    ids = sorted(weight)
    d2 = {(i, j): 0.0 if i == j else (1 - scores.get((min(i, j), max(i, j)), 0.0)) ** 2 for i in ids for j in ids}

    def mean(p, q):
        return sum(weight[i] * weight[j] * d2[i, j] for i in p for j in q) / sum(weight[i] for i in p) / sum(weight[j] for j in q)

    groups = [(i,) for i in ids]
    while True:
        near = {}
        for p, q in itertools.combinations(groups, 2):
            d = mean(p, q) - mean(p, p) / 2 - mean(q, q) / 2
            if d <= (1 - threshold) ** 2 and any((min(i, j), max(i, j)) in (edges or scores) for i in p for j in q):
                for x, y in ((p, q), (q, p)):
                    near[x] = min(near.get(x, (9, None)), (d, y))
        merged = {p for p in near if near[near[p][1]][1] == p}
        if not merged:
            return {i: min(g) for g in groups for i in g}
        groups = [g for g in groups if g not in merged] + [p + near[p][1] for p in merged if min(p) < min(near[p][1])]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_agree_with_the_definition(spark, seed):
    rng = random.Random(seed)
    weight = {i: rng.choice([1, 1, 1, 3]) for i in range(40)}
    scores = {(i, j): rng.uniform(0.5, 1) for i, j in itertools.combinations(range(40), 2) if i % 4 == j % 4 and rng.random() < 0.8 or rng.random() < 0.02}
    items = spark.createDataFrame([(i, w, 0.9) for i, w in weight.items()], "record_id long, copies int, own double")
    edges = spark.createDataFrame([(*k, v) for k, v in scores.items()], "left_id long, right_id long, score double")
    got = {r.record_id: r for r in cluster.agglomerate(items, edges, 0.5).collect()}
    want = clusters_by_definition(weight, scores, 0.5)
    assert {i: r.cluster_id for i, r in got.items()} == want and len(set(want.values())) < 40
    for i in weight:
        mates = [j for j in weight if want[j] == want[i] and j != i]
        total = sum(weight[j] * (1 - scores.get((min(i, j), max(i, j)), 0.0)) ** 2 for j in mates) + (weight[i] - 1) * 0.1**2
        others = sum(weight[j] for j in mates) + weight[i] - 1
        assert got[i].confidence_score == pytest.approx(1 - math.sqrt(total / others) if others else 1.0)


@pytest.mark.parametrize("seed", range(4))
def test_missing_scores_are_asked_for_late(spark, seed):
    """The clusters are those of all scores, of which only some are ever asked for."""
    rng = random.Random(seed)
    weight = {i: rng.choice([1, 1, 1, 3]) for i in range(48)}
    scores = {p: rng.uniform(0.5, 1) if (p[0] % 6 == p[1] % 6 and rng.random() < 0.6) or rng.random() < 0.01 else rng.uniform(0.0, 0.499)
              for p in itertools.combinations(range(48), 2)}
    matches = {k for k, v in scores.items() if v >= 0.5}
    items = spark.createDataFrame([(i, w, 1.0) for i, w in weight.items()], "record_id long, copies int, own double")
    every = spark.createDataFrame([(*k, v) for k, v in scores.items()], "left_id long, right_id long, score double")
    asked = []

    def scorer(pairs):
        asked.extend((r.left_id, r.right_id) for r in pairs.collect())
        return pairs.join(every, ["left_id", "right_id"])

    got = {r.record_id: r for r in cluster.agglomerate(items, every.filter("score >= 0.5"), 0.5, scorer).collect()}
    want = clusters_by_definition(weight, scores, 0.5, matches)
    assert {i: r.cluster_id for i, r in got.items()} == want and 1 < len(set(want.values())) < 40
    assert len(asked) == len(set(asked)) and not matches & set(asked) and 0 < len(asked) < len(scores) / 2
    for i in weight:
        mates = [j for j in weight if want[j] == want[i] and j != i]
        total, others = sum(weight[j] * (1 - scores[min(i, j), max(i, j)]) ** 2 for j in mates), sum(weight[j] for j in mates) + weight[i] - 1
        assert got[i].confidence_score == pytest.approx(1 - math.sqrt(total / others) if others else 1.0)


@pytest.mark.parametrize("members", [6, 300])
def test_components_of_every_size_follow_one_rule(spark, members):
    """All match all at one score: one cluster, whatever its size, in few rounds in spite of the ties."""
    items = spark.range(members).selectExpr("id as record_id", "1 as copies", "1.0D as own")
    edges = items.alias("a").join(items.alias("b"), F.expr("a.record_id < b.record_id")).selectExpr("a.record_id as left_id", "b.record_id as right_id", "0.622D as score")
    got = cluster.agglomerate(items, edges, 0.5).collect()
    assert len(got) == members and {(r.cluster_id, round(r.confidence_score, 6)) for r in got} == {(0, 0.622)}


def test_a_hub_is_split(spark):
    """Both sides of the joins of a star are exchanged, so adaptive execution can split the hub's rows."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                           "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    for k, v in zip(keep, ("-1", "8k", "4k", "1.2")):
        spark.conf.set(k, v)
    try:
        star = spark.range(60_000).selectExpr("id + 100 as u", "0L as v").union(spark.range(1, 40).selectExpr("id as u", "0L as v"))
        joined = cluster._large_star(star)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


SIMPLE = MatchModel((FieldSpec("a", "Exact", False), FieldSpec("b", "Edit", False)), {"a": 3.0, "b": 3.0}, -4.0)
SIMPLE_RULES = [rule(("whole_field", "a"))]


def test_copies_are_folded_and_all_labelled(spark):
    rows = [(i, "k", "same") for i in range(100, 160)] + [(1, "k", "sama"), (2, "other", "same"), (3, "", "blank"), (4, "", "blank")]
    df = spark.createDataFrame(rows, "record_id long, a string, b string")
    folded = dedupe.fold_copies(df, SIMPLE_RULES, SIMPLE, 0.5)
    assert folded.filter("record_id = item").count() == 5  # the blank ones have no key: not candidates of each other
    got = {r.record_id: r.cluster_id for r in dedupe.match_components(df, SIMPLE, SIMPLE_RULES).collect()}
    assert got == {**{i: 1 for i in range(100, 160)}, 1: 1, 2: 2, 3: 3, 4: 4}
    full = {r.record_id: r for r in dedupe.get_clusters(df, SIMPLE, SIMPLE_RULES).collect()}
    assert {k: v.cluster_id for k, v in full.items()} == got
    assert full[2].confidence_score == 1.0 and 0.5 < full[1].confidence_score < full[100].confidence_score < 1


def test_clusters_of_persons(spark):
    people = clean_persons(spark, SF_DIR)
    got = dedupe.get_clusters(people, MODEL, BLOCKING)
    assert got.count() == people.count() == got.select("record_id").distinct().count()
    mixed = got.join(people.select("record_id", "entity_id"), "record_id").groupBy("cluster_id").agg(
        F.count_distinct("entity_id").alias("n")).filter("n > 1")
    assert mixed.isEmpty()
    assert got.filter("confidence_score < 0 or confidence_score > 1").isEmpty()


def test_pairs_below_the_threshold_keep_their_distance(spark):
    """a-b and b-c match, a-c does not (hard part 8): with its true score the chain is one cluster, with distance 1 it is not."""
    rows = [(1, ["p"], "aaaaaaaaaa"), (2, ["p", "q"], "aaaaaaaabb"), (3, ["q"], "aaaaaabbbb")]
    model = MatchModel((FieldSpec("e", "Overlap", False), FieldSpec("b", "Edit", False)), {"e": 3.0, "b": 2.0}, -1.6)
    df = spark.createDataFrame(rows, "record_id long, e array<string>, b string")
    rules = [rule(("common_set_element", "e"))]
    logistic = lambda x: 1 / (1 + math.exp(-x))
    near, far = 1 - logistic(3 + 1.6 - 1.6), 1 - logistic(2 * 0.6 - 1.6)
    got = {r.record_id: r for r in dedupe.get_clusters(df, model, rules).collect()}
    assert far > 0.5 and {r.cluster_id for r in got.values()} == {1}
    assert got[1].confidence_score == pytest.approx(1 - math.sqrt((near**2 + far**2) / 2))
    assert got[2].confidence_score == pytest.approx(1 - near)
    assert len({r.cluster_id for r in dedupe.get_clusters(df, model, rules, score_missing=False).collect()}) == 2


def test_linking_one_record(spark):
    people = clean_persons(spark, SF_DIR)
    one = people.filter("record_id = 121").withColumn("record_id", F.lit(-1).cast("long"))
    links = link.ranked_links(link.link_records(one, people, BLOCKING, MODEL)).collect()
    assert [r.record_id for r in links] == [121, 120, 122] and {r.query_id for r in links} == {-1}
    request = spark.createDataFrame([(["Doe"], ["John"], [33123])], "family_name_list array<string>, first_name_list array<string>, telephones array<long>")
    assert link.from_record_info(request).dtypes == [("birth_family_name_list", "array<string>"),
                                                     ("birth_first_name_list", "array<string>"), ("telephones", "array<string>")]


def test_learning_round_trip(spark, tmp_path):
    people = clean_persons(spark, SF_DIR)
    labels = person_labels(spark, SF_DIR)
    fields = (FieldSpec("birth_family_name", "Edit", False), FieldSpec("emails", "Overlap", False), FieldSpec("birth_date", "Exact"))
    candidates = [*BLOCKING, rule(("double_metaphone", "birth_family_name"), ("whole_field", "birth_date"))]
    model, rules = learn.load_or_fit(str(tmp_path / "m"), people, labels, fields, candidates)
    again, same_rules = learn.load_or_fit(str(tmp_path / "m"), people, labels, fields, candidates)
    assert rules == same_rules and again.bias == model.bias and dict(again.weights) == dict(model.weights)
    assert model.weights["emails"] > 0
    alone, _ = learn.load_model(spark, str(tmp_path / "m"))
    assert alone.fields == fields == learn.saved_fields(spark, str(tmp_path / "m"))
    covered = learn.predicate_coverage(people, labels, rules)
    assert covered.filter("size(covers) = 0").isEmpty()
    assert rule(("same_seven_char_start", "birth_family_name")) not in rules
    found = scoring.matching_pairs(people, rules, model, 0.5)
    truth = labels.filter("label = 1")
    row = learn.evaluate(found, truth).first()
    assert row.precision > 0.95 and row.recall > 0.95
    assert dedupe.run("getModelsInfo", spark, {1: str(tmp_path / "m")}).filter("feature = 'emails'").first().n_labels == labels.count()
    with pytest.raises(FileNotFoundError):
        dedupe.run("getModelsInfo", spark, {2: str(tmp_path / "absent")})


def test_hundreds_of_candidate_rules(spark):
    people = clean_persons(spark, SF_DIR).select("record_id", "entity_id", "birth_family_name", "emails", "birth_date")
    many = [rule(("token_field", "birth_family_name"), ("same_three_char_start", "birth_date"))] + [
        rule(("whole_field", "birth_date"), (p, "birth_family_name")) for p in ("first_token", "fingerprint", "two_gram_fingerprint")] + list(BLOCKING)
    many = many * 12  # 84 rules: more than one integer has bits
    chosen = learn.learn_predicates(people, person_labels(spark, SF_DIR), many)
    assert rule(("common_set_element", "emails")) in chosen and len(chosen) <= 3


def test_models_must_fit_their_fields():
    with pytest.raises(ValueError, match="nope"):
        MatchModel(SIMPLE.fields, {"nope": 1.0}, 0.0)


def test_label_history(spark):
    old = spark.createDataFrame([(1, 2, 0, 1), (1, 3, 1, 1)], "left_id long, right_id long, label int, ts int")
    new = spark.createDataFrame([(1, 2, 1, 2)], "left_id long, right_id long, label int, ts int")
    assert {tuple(r) for r in learn.apply_labels(old, new).collect()} == {(1, 2, 1), (1, 3, 1)}
    sample = learn.prepare_training(new, 5, old.select("left_id", "right_id", "label"))
    assert {tuple(r) for r in sample.collect()} == {(1, 2, 0), (1, 3, 1)}
    nothing = learn.evaluate(new.filter("false"), old).first()
    assert tuple(nothing) == (0.0, 0.0, 0.0, 0)


def test_field_selection_and_config(tmp_path):
    chosen = {s.field: s.type for s in select_fields(["sex", "birth_first_name", "birth_family_name", "emails"], MatchConfig())}
    assert chosen == {"sex": "Exact", "birth_first_name": "String", "birth_family_name": "String", "emails": "Custom",
                      "combined_full_name_birth": "Interaction"}
    assert [s.type for s in select_fields(["civility", "usage_first_name", "q"], MatchConfig(fields=(FieldSpec("zz", "Exact"),)))] == ["Text", "Exact"]
    (tmp_path / "c.json").write_text('{"defaults": {"cluster_threshold": 0.7}, "dataset": {"list_nested_columns": ["emails"]}, '
                                     '"variables_setting": {"sex": {"type": "Exact"}}}')
    config = load_config(str(tmp_path / "c.json"))
    assert config.cluster_threshold == 0.7 and config.nested_columns == ("emails",) and [s.field for s in config.fields] == ["sex"]


def test_unknown_operation():
    with pytest.raises(LookupError, match="404"):
        dedupe.run("nope")


@pytest.mark.parametrize("max_block", [1, 3, 1000])
def test_pair_sharing_many_keys_meets_once(spark, max_block):
    # a pair of records that share several words came out once per shared word
    rng = random.Random(3)
    words = ["red", "blue", "green", "hot", "pale"]
    rows = [(i, " ".join(rng.sample(words, 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id long, name string")
    carried = blocking.candidate_pairs(df, [rule(("token_field", "name"))], payload=["name"], max_block=max_block)
    got = sorted((r[0], r[1]) for r in carried.select("left_id", "right_id").collect())
    want = sorted((x[0], y[0]) for x, y in itertools.combinations(rows, 2) if set(x[1].split()) & set(y[1].split()))
    assert got == want
