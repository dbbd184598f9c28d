"""Similarities against plain dynamic programs, phonetic codes against known ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import blockkeys as bk
from twinfold.functions import similarity as sim
from twinfold.functions.phonetic import double_metaphone_codes


def plain_gap(a, b, match=1, mismatch=11, gap_open=10, extend=7):
    """Cheapest alignment with gaps of cost open + extend * length, by the three-state recurrence."""
    inf = float("inf")
    d = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                continue
            best = d[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch) if i and j else inf
            best = min([best] + [d[i - k, j] + gap_open + extend * k for k in range(1, i + 1)]
                       + [d[i, j - k] + gap_open + extend * k for k in range(1, j + 1)])
            d[i, j] = best
    return d[len(a), len(b)] / max(1, len(a) + len(b))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(prev[j - 1] + 1 if x == y else max(prev[j], row[-1]))
    return row[-1]


def word_pairs(n=150, longest=9):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, longest)))
    return [(word(), word()) for _ in range(n)]


def test_affine_gap(spark):
    pairs = word_pairs()
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.affine_gap()("a", "b").alias("d"),
                                                                    sim.affine_gap()("b", "a").alias("e")).collect()
    for r in rows:
        assert r.d == pytest.approx(plain_gap(r.a, r.b)) and r.d == pytest.approx(r.e)
    assert sim._affine_gap_block(["same"], ["same"], (1.0, 11.0, 10.0, 7.0))[0] == 0.5


def test_least_affine_gap_is_no_more_than_the_distance(spark):
    pairs = word_pairs(300)
    rows = spark.createDataFrame([*pairs, *((a, a[1:] + "b") for a, _ in pairs)], "a string, b string").selectExpr("a", "b", f"{sim.least_affine_gap('a', 'b')} as d").collect()
    assert all(r.d <= plain_gap(r.a, r.b) + 1e-9 for r in rows if r.a or r.b)
    assert sum(r.d > plain_gap(r.a, r.b) - 1e-9 for r in rows) > 100


def test_ratio(spark):
    for r in spark.createDataFrame(word_pairs(), "a string, b string").select("a", "b", sim.ratio("a", "b").alias("v")).collect():
        total = len(r.a) + len(r.b)
        assert r.v == pytest.approx(200 * plain_lcs(r.a, r.b) / total if total else 100.0)


def test_long_texts_are_compared_whole():
    a, b = "ab" * 3000 + "x", "ab" * 3000 + "y"
    assert sim._ratio_block([a], [b])[0] == pytest.approx(200 * 6000 / 12002)
    assert np.isclose(sim._affine_gap_block([a], [b], (1.0, 11.0, 10.0, 7.0))[0], (6000 + 11) / 12002)


@pytest.mark.parametrize("letters, longest", [("ab", 7), ("abc", 30), ("abcdé\0日😀", 90)])
def test_close_items_agree_with_all_pairs(letters, longest):
    rng = random.Random(longest)
    left = ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(60)]
    right = [x[:k] + rng.choice(letters) * rng.randrange(2) + x[k + rng.randrange(2):] for x in left for k in (0, rng.randrange(len(x)))]
    near = lambda x, y: 200 * plain_lcs(x, y) > 85 * (len(x) + len(y))
    found = [(i, j) for a, b in sim.close_items(left, right, False, 5) for i, j in zip(a, b)]
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if max(len(x), len(y)) > 5 and near(x, y)}
    assert len(found) == len(set(found)) and set(found) == want and want
    found = [tuple(sorted(p)) for a, b in sim.close_items(right, right, True) for p in zip(a, b)]
    want = {(i, j) for j, y in enumerate(right) for i, x in enumerate(right[:j]) if near(x, y)}
    assert len(found) == len(set(found)) and set(found) == want
    assert not list(sim.close_items(left, [], False))


def test_lists_similar_agrees_with_all_pairs(spark):
    rng = random.Random(3)
    base = ["marie.dupont@mail.org", "jean.martin@mail.org", "0612345678", "x"]
    def typo(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice("ab1") + s[i + rng.randint(0, 1):]
    rows = [([typo(rng.choice(base)) for _ in range(rng.randint(0, 3))], [typo(rng.choice(base)) for _ in range(rng.randint(0, 3))])
            for _ in range(120)]
    df = spark.createDataFrame([((a,), (b,)) for a, b in rows], "l struct<e: array<string>>, r struct<e: array<string>>")
    got = [r[0] for r in sim.with_near_items(df, ["e"]).select(sim.lists_similar("e")).collect()]
    want = [float(any(200 * plain_lcs(x, y) > 85 * (len(x) + len(y)) for x in a for y in b)) for a, b in rows]
    assert got == want and 0 < sum(want) < len(want)


@pytest.mark.parametrize("word, codes", [
    ("smith", ("SM0", "XMT")), ("schmidt", ("XMT", "SMT")), ("thomas", ("TMS", "TMS")), ("knight", ("NT", "NT")),
    ("wright", ("RT", "RT")), ("catherine", ("K0RN", "KTRN")), ("katherine", ("K0RN", "KTRN")), ("jose", ("HS", "HS")),
    ("philip", ("FLP", "FLP")), ("caesar", ("SSR", "SSR")), ("michael", ("MKL", "MXL")), ("czerny", ("SRN", "XRN")),
    ("accident", ("AKST", "AKST")), ("bacher", ("PKR", "PKR")), ("judge", ("JJ", "AJ")), ("xavier", ("SF", "SFR")),
    ("wasserman", ("ASRM", "FSRM")), ("cagney", ("KKN", "KKN")), ("laugh", ("LF", "LF")), ("school", ("SKL", "SKL")),
])
def test_double_metaphone(word, codes):
    assert double_metaphone_codes(word) == codes


@pytest.mark.parametrize("word, code", [
    ("knight", "NT"), ("metaphone", "MTFN"), ("school", "SKL"), ("science", "SNS"), ("wright", "RT"), ("which", "WX"),
    ("phonetic", "FNTK"), ("judge", "JJ"), ("apple", "APL"),
])
def test_metaphone(spark, word, code):
    df = spark.createDataFrame([(word,)], "t string")
    assert df.select(bk.keys("metaphone_token", "t")).first()[0] == [code]


@pytest.mark.parametrize("predicate, value, want", [
    ("whole_field", "", []), ("first_two_tokens", "one", []), ("common_four_gram", "abc", []), ("common_four_gram", "abcde", ["abcd", "bcde"]),
    ("near_integers", "7 rue", ["6", "7", "8"]), ("hundred_integer", "149 150", ["100", "200"]), ("hundred_integers_odd", "151", ["201"]),
    ("suffix_array", "a bcde", ["abcde", "bcde"]), ("one_gram_fingerprint", "baba c", ["abc"]), ("two_gram_fingerprint", "abab", ["abba"]),
    ("sorted_acronym", "zoe anna", ["az"]), ("fingerprint", "b a", ["a b"]), ("common_three_tokens", "a b c d", ["a b c", "b c d"]),
])
def test_text_predicates(spark, predicate, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(bk.keys(predicate, "t")).first()[0] == want


def test_set_and_number_predicates(spark):
    df = spark.createDataFrame([(["c", "a", "b", "", "a"], 0.0347, 6789.0)], "s array<string>, x double, y double")
    got = lambda p, v: df.select(bk.keys(p, v)).first()[0]
    assert got("whole_set", "s") == ["a b c"] and got("common_set_element", "s") == ["a", "b", "c"]
    assert got("common_two_elements", "s") == ["a b", "a c", "b c"] and got("common_three_elements", "s") == ["a b c"]
    assert got("last_set_element", "s") == ["c"] and got("first_set_element", "s") == ["a"]
    assert got("magnitude_of_cardinality", "s") == ["0"] and got("order_of_magnitude", "y") == ["4"]
    assert got("round_to_1", "x") == ["0.030000"] and got("round_to_1", "y") == ["7000.000000"]
    assert df.select(F.expr(bk.lat_long_grid("0.0D", "0.0D"))).first()[0] == []
    assert df.select(F.expr(bk.lat_long_grid("48.8566D", "2.3522D"))).first()[0] == ["48.9_2.4"]
