import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.config import FieldSpec
from twinfold.functions import similarity as sim
from twinfold.operators import blocking, link, nearness, scoring
from twinfold.operators.blocking import rule
from twinfold.operators.nearness import Nearness, near_pairs
from twinfold.plans import dedupe
from twinfold.plans.persons import persons
from twinfold.plans.queries_match import LEARNED, configured_labels

from conftest import SF_DIR


def texts(seed):
    rng = random.Random(seed)
    letters = "abc" if seed % 2 else "abcdefgh .0123"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 34))) for _ in range(45)]
    out = set(roots)
    for t in roots:
        for _ in range(5):
            x = list(t)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(x) + 1)
                x[k: k + rng.randrange(2)] = rng.choice(("", rng.choice(letters)))
            out.add("".join(x))
    return sorted(out - {""})


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("cutoff", [None, 0.5, 0.9, 1.3, 2.0])
def test_near_pairs_equal_all_comparisons(spark, seed, cutoff):
    values = texts(seed)
    every = [(x, y) for i, x in enumerate(values) for y in values[i + 1:]]
    if cutoff is None:
        near = sim._blocked(every, sim._ratio_block) > sim.LIST_SIMILARITY_THRESHOLD
    else:
        near = sim._blocked(every, lambda a, b: sim._affine_gap_block(a, b, (1.0, 11.0, 10.0, 7.0))) <= cutoff + 1e-9
    want = {p for p, n in zip(every, near) if n}
    frame = spark.createDataFrame([(v,) for v in [*values, "", values[0], None]], "value string")
    got = [(r.a, r.b) for r in near_pairs(frame, Nearness(cutoff)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want or cutoff == 0.5


def test_items_with_parts_in_common_need_few_comparisons(spark, monkeypatch):
    rng = random.Random(3)
    values = sorted({f"{rng.choice(['cold', 'hot', 'large'])}.{rng.choice(['bolt', 'ring', 'gear'])}{''.join(rng.choices('aeioulnrst', k=5))}{end}"
                     for end in ("@example.com", "") for _ in range(150)})
    every = [(x, y) for i, x in enumerate(values) for y in values[i + 1:]]
    want = {p for p, v in zip(every, sim._blocked(every, sim._ratio_block)) if v > sim.LIST_SIMILARITY_THRESHOLD}
    asked, confirmed = [], Nearness.confirmed
    monkeypatch.setattr(Nearness, "confirmed", lambda self, pairs: asked.append(pairs.count()) or confirmed(self, pairs))
    monkeypatch.setattr(nearness, "PIECE", 40, raising=False)  # several pieces of one length
    got = [(r.a, r.b) for r in near_pairs(spark.createDataFrame([(v,) for v in values], "value string"), Nearness()).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    # the letter pairs of the common parts made nearly every pair of long items a candidate
    assert sum(asked) < len(every) / 10


def test_left_out_letters_equal_the_best_alignments():
    rng = np.random.default_rng(1)
    for cutoff in (None, 1.2, 2.0):
        for _ in range(300):
            a, b = rng.integers(1, 9, 2)
            # the bound may not be less than what a near pair of these lengths leaves out
            x, y = "".join(rng.choice(list("ab"), a)), "".join(rng.choice(list("ab"), b))
            if cutoff is None and sim._ratio_block([x], [y])[0] > 85:
                assert a - sim._common_length_block([x], [y])[0] <= Nearness(cutoff).left_out(a, b)


def test_cutoffs_that_no_filter_serves_are_refused():
    with pytest.raises(ValueError):
        Nearness(2.5)


@pytest.mark.parametrize("seed", range(4))
def test_near_rules_find_every_match_from_fewer_pairs(spark, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(4, 11))) for _ in range(12)]
    mails = ["".join(rng.choice("abcdefgh.") for _ in range(rng.randint(6, 18))) for _ in range(12)]

    def spelled(x):
        k = rng.randrange(len(x))
        return x if rng.random() < 0.5 else x[:k] + rng.choice("xyz") + x[k + rng.randrange(2):]

    rows = [(i, rng.choice("mf"), "" if rng.random() < 0.1 else spelled(rng.choice(names)),
             [spelled(rng.choice(mails)) for _ in range(rng.randint(0, 2))], rng.choice(["1990-01-01", "1990-01-05", "1971-03-02", ""])) for i in range(140)]
    df = spark.createDataFrame(rows, "record_id long, sex string, name string, mails array<string>, born string")
    fields = (FieldSpec("sex", "Exact", False), FieldSpec("name", "String"), FieldSpec("mails", "Custom"), FieldSpec("born", "DateTime"),
              FieldSpec("both", "Interaction", parts=("name", "mails")))
    weights = {"sex": 0.5, "name": -round(rng.uniform(3, 6), 2), "name__missing": -6.0, "mails": 2.0, "mails__missing": -0.5,
               "born": -0.02, "born__missing": -0.2, "both": rng.choice([-0.3, 0.0, 0.2])}
    model = scoring.MatchModel(fields, weights, 2.5)
    blocking_rules = [rule(("whole_field", "sex")), rule(("whole_field", "born"))]
    every = blocking.candidate_pairs(df, blocking_rules)
    scored = scoring.keep_matches(scoring.score_pairs(blocking.hydrate(every, df, model.columns), model), 0.5)
    want = sorted((r.left_id, r.right_id) for r in scored.collect())
    assert want and sorted((r.left_id, r.right_id) for r in scoring.matching_pairs(df, blocking_rules, model, 0.5).collect()) == want
    rules, (keyed,) = scoring.tightened(blocking_rules, model, 0.5, df)
    assert all(any(p == "near" for p, _ in r) for r in rules)
    assert blocking.candidate_pairs(keyed, rules).count() * 4 < every.count()
    new, base = df.filter("record_id < 40").withColumn("record_id", -F.col("record_id") - 1), df
    links = link.link_records(new, base, blocking_rules, model, 0.5)
    got = {(-r.query_id - 1, r.record_id) for r in links.collect()}
    assert {(a, b) for a, b in got if a != b} == {p for x, y in want for p in ((x, y), (y, x)) if p[0] < 40}


@pytest.mark.parametrize("seed", range(2))
def test_pairs_out_of_reach_are_not_compared(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("aeinorst") for _ in range(n))
    names, mails = [word(rng.randint(3, 9)) for _ in range(20)], [word(12) for _ in range(20)]
    rows = [(i, "m", rng.choice([*names, "", None]), [m[:k] + m[k + rng.randrange(2):] for m in rng.sample(mails, rng.randrange(3)) for k in [rng.randrange(12)]],
             rng.choice(["1990-01-01", "1990-01-05", "1931-03-02", "no date", ""])) for i in range(120)]
    df = spark.createDataFrame(rows, "record_id long, sex string, name string, mails array<string>, born string")
    fields = (FieldSpec("sex", "Exact", False), FieldSpec("name", "String"), FieldSpec("mails", "Custom"), FieldSpec("born", "DateTime"),
              FieldSpec("name", "Custom", False, name="initial", comparator=lambda a, b: (F.left(a, F.lit(1)) == F.left(b, F.lit(1))).cast("double"), bounds=(0.0, 1.0)),
              FieldSpec("both", "Interaction", parts=("name", "mails")))
    # a missing date and name count in favour, so no near agreement is needed
    weights = {"sex": 0.5, "name": -1.5, "name__missing": -1.0, "mails": 2.0, "mails__missing": 0.3, "born": -0.03, "born__missing": 1.2, "initial": 0.4,
               "both": (-0.3, 0.2)[seed]}
    model = scoring.MatchModel(fields, weights, 1.0)
    rules = [rule(("whole_field", "sex"))]
    assert scoring.tightened(rules, model, 0.5, df)[0] == rules
    every = blocking.candidate_pairs(df, rules)
    scored = scoring.keep_matches(scoring.score_pairs(blocking.hydrate(every, df, model.columns), model), 0.5)
    want = {(r.left_id, r.right_id): r.score for r in scored.collect()}
    asked, score_pairs = [], scoring.score_pairs
    monkeypatch.setattr(scoring, "score_pairs", lambda pairs, m: asked.append(pairs.count()) or score_pairs(pairs, m))
    got = {(r.left_id, r.right_id): r.score for r in scoring.matching_pairs(df, rules, model, 0.5).collect()}
    assert got == pytest.approx(want) and len(want) > 100
    assert sum(asked) < every.count() * 0.7


def test_labels_lead_to_clusters_and_links(spark, tmp_path):
    people = persons(spark, SF_DIR)
    prepared = dedupe.prepare(people, LEARNED)
    labels = configured_labels(prepared)
    path = str(tmp_path / "model")
    members, counts = dedupe.dedupe(people, config=LEARNED, labels=labels, model_path=path)
    members = {r.record_id: r.cluster_id for r in members.collect()}
    assert len(members) == people.count() == counts.first().records_count
    # the saved model wins over labels, and is the one that scoring every candidate gives
    model, rules = dedupe.learned(prepared, None, LEARNED, path=path)
    again, _ = dedupe.dedupe(people, config=LEARNED, model_path=path)
    assert {r.record_id: r.cluster_id for r in again.collect()} == members
    pairs = blocking.candidate_pairs(prepared, rules)
    every = scoring.keep_matches(scoring.score_pairs(blocking.hydrate(pairs, prepared, model.columns), model), 0.5)
    assert sorted((r.left_id, r.right_id) for r in every.collect()) == sorted(
        (r.left_id, r.right_id) for r in scoring.matching_pairs(prepared, rules, model, 0.5).collect())
    same = sum((a // 10 == b // 10) == (members[a] == members[b]) for a in members for b in members if a < b)
    assert same > 0.995 * len(members) * (len(members) - 1) / 2
    few = people.filter("entity_id % 50 = 0")
    links = dedupe.link_dataset(few, people, config=LEARNED, model_path=path, confidence=0.6).collect()
    assert {r.query_id for r in links} and all(r.confidence_score >= 0.6 for r in links)
    with pytest.raises(ValueError):
        dedupe.dedupe(people, config=LEARNED)
