import random
from itertools import permutations

import pytest

from twinfold.llm import audit


def brute(rows, labels):
    """The rows of the audit by removing documents one after the other."""
    docs = []
    for k, (i, text, part) in enumerate(rows):
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        docs.append((k, part or "", {f for f in fails if fails[f]}, (i, "q") in labels, (i, "t") in labels))
    out = {}
    for part in {d[1] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[1] == part]
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[2]]
                failing = [d for d in docs if d[1] == part and f in d[2]]
                left = [d for d in left if f not in d[2]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), len(failing) - len(removed), sum(d[2] == {f} for d in failing),
                                                   sum(d[3] for d in removed), sum(d[4] for d in removed), f]
        for key, x in out.items():
            if key[0] == part:
                x[6] = shapley[x[6]]
    return {k: tuple(v) for k, v in out.items()}


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, list int")
    marks = [(i, 1 if k == "q" else 0, 1 if k == "t" else None) for i, k in labels]
    return docs, spark.createDataFrame([*marks, (None, 1, 1)], "doc_id long, quality int, toxic int")


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_removal_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BITS", 2)
    rng = random.Random(5)
    vocabulary = [*"abcdefghij", "Big", "CAPS", "#", "x|y", "é", "\n", "\t"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 49, 50, 70)))) for _ in range(30)]
    texts += [" ".join(f"w{k}" for k in range(60)), "word " * 40_000, None, "", " \n"]
    rows = [(i if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(("a", "b", "b", "b", "", None))) for i in range(150)]
    rows += rows[:5]  # repeated rows
    labels = {(i, k) for i in range(150) for k in "qt" if rng.random() < 0.4}
    assert result(audit.audit(*frames(spark, rows, labels))) == brute(rows, labels)


def test_no_rows_and_one_row(spark):
    docs, labels = frames(spark, [(1, None, None)], set())
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert result(audit.audit(docs, labels.limit(0))) == brute([(1, None, None)], set())


@pytest.mark.parametrize("seed", range(20))
def test_galloping_merge_equals_sets(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(300), rng.choice((0, 1, 5, 150, 299)))) for _ in range(5)]
    want = {}
    for x in range(300):
        mask = sum(1 << k for k, values in enumerate(lists) if x in values)
        if mask:
            want[mask] = want.get(mask, 0) + 1
    assert audit.difference_sizes(lists) == want
    for numbers in lists:
        for target in range(0, 301, 7):
            assert audit.leap(numbers, 0, target) == sum(x < target for x in numbers)
