import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinfold.llm import bytestext, minhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(docs):
    """Sets, links by counting shared shingles, union-find."""
    sets = {i: shingles(t) for i, t in docs}
    holders, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed=5):
    """A large group of near copies, copies edited to all degrees, texts that share a passage to all degrees, small groups."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]

    def edited(words, n):
        words = words[:]
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(pool)
        return words

    base, graded, passage = some(120), some(130), some(90)
    docs = [edited(base, rng.randint(0, 3)) for _ in range(90)]
    docs += [edited(graded, int(rng.random() ** 2 * 40))[rng.randint(0, 4): 130 - rng.randint(0, 4)] for _ in range(70)]
    for n in (40, 60, 20, 10, 30, 25):
        docs += [(r := some(n))[: n // 2] + passage + r[n // 2:] for _ in range(20)]
    docs += [base[: rng.randint(60, 120)] + some(rng.randint(5, 60)) for _ in range(30)]
    for _ in range(20):
        first = some(rng.choice([3, 8, 20, 60, 200]))
        docs += [edited(first, rng.randint(0, 4)) for _ in range(rng.randint(1, 20))]
    docs = [(k, " ".join(words)) for k, words in enumerate(docs)]
    docs += [(5000 + k, docs[0][1].upper()) for k in range(60)] + [(6000, ""), (6001, " \n"), (6002, "a"), (6003, "A "), (6004, "a b"), (6005, "b a")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("long_list", [32, 4])
def test_components_equal_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(minhash, "LONG_LIST", long_list)
    docs = corpus()
    want = components(docs)
    frame = spark.createDataFrame([*docs, (6100, None), (None, "a"), docs[3], docs[3]], "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("n", F.lit(2))
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(docs) + 4
    for r in got:
        if r.doc_id in want:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id == r.doc_id and r.kept


def test_rows_that_stay(spark):
    docs = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "other words here"), (4, None), (5, "")]
    frame = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, u string")
    left = minhash.drop_near_duplicates(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5]
    assert minhash.near_duplicates(frame.limit(0)).collect() == [] and minhash.drop_near_duplicates(frame.limit(0)).collect() == []


def test_hashes_follow_words_and_chunks():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "Ab", "c", "x" * 70, "é"]) + rng.choice(["", " ", "\n\t"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [None, "", " ", "a", "long " * 50_000]
    sets = {}
    for most in (1 << 20, 64):
        sets[most] = [s.tolist() for _, c in bytestext.chunks(pa.array(texts), most) for s in bytestext.shingle_sets(c, 5)]
    assert sets[64] == sets[1 << 20] and len(sets[64]) == len(texts)
    want = [shingles(t) for t in texts]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(want[i] & want[j]) == len(set(sets[64][i]) & set(sets[64][j]))
    sliced = pa.array(texts).slice(5, 50)
    assert [s.tolist() for _, c in bytestext.chunks(sliced) for s in bytestext.shingle_sets(c, 5)] == sets[64][5:55]


def test_signatures_estimate_the_similarity():
    rng = random.Random(4)
    words = ["%06x" % rng.randrange(16**6) for _ in range(600)]
    a, b = " ".join(words[:500]), " ".join(words[100:])
    (_, chunk), = bytestext.chunks(pa.array([a, b]))
    sig = minhash._signatures(bytestext.shingle_sets(chunk, 5))
    assert abs((sig[0] == sig[1]).mean() - 396 / 596) < 0.2
