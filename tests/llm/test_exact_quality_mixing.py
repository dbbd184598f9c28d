import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinfold.llm import exact, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=400):
    """Copies, nulls, empty texts, a hot source, a null source and some long texts."""
    rng = random.Random(seed)
    words = "red blue one two sky sun | # été".split()
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(rng.choice([3, 9, 30]))) for _ in range(rng.randint(1, 6)))
        text = rng.choice([text, text, text, "hot copy", "", None, "a b a b a b a b " * rng.randint(1, 40), text + "\n" + text])
        rows.append((i, text, rng.choice(["de", "en", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None, "s10"]), 1))
    rows.append((n, "long text " * 40_000, "en", "s2", 1))
    return rows


def test_copies(spark):
    rows = documents()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    # a tiny filter lets nearly every row through to the groups: the result is the same
    for bits in (1 << 27, 1024):
        got = exact.copy_groups(frame, max_bits=bits).collect()
        assert len(got) == len(rows)
        for r in got:
            g = groups[dict((x[0], x[1]) for x in rows)[r.doc_id] or ""]
            assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
            assert r.text_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()
    left = exact.drop_copies(frame.withColumn("filter", F.lit(1)).withColumn("word", F.lit(2)))
    assert left.columns == [*frame.columns, "filter", "word"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(max(g) for g in groups.values())


def test_repeated_rows_and_no_rows(spark):
    twice = spark.createDataFrame([(1, "a", None, None, 1)] * 3 + [(2, "b", None, None, 1)], DOCS)
    assert sorted(r.doc_id for r in exact.drop_copies(twice).collect()) == [1, 2]
    assert {(r.doc_id, r.group_size, r.kept) for r in exact.copy_groups(twice).collect()} == {(1, 3, True), (2, 1, True)}
    none = spark.createDataFrame([], DOCS)
    assert exact.copy_groups(none).collect() == exact.drop_copies(none).collect() == []
    assert quality.judge(none).collect() == mixing.mixture(none).collect() == mixing.mixed(none).collect() == []


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rows = documents(3)
    frame = spark.createDataFrame(rows, DOCS).withColumn("level", F.lit(0)).withColumn("own", F.lit("x"))
    got = quality.judge(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        n, *rest = base_counts(rows[r.doc_id][1])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest]
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n) and not (r.kept and r.base_failed)


def test_thresholds_follow_the_source(spark):
    """A source that is full of symbols keeps its texts; one text like that among others goes."""
    rng = random.Random(5)
    plain = lambda: " ".join("%06x" % rng.randrange(16**6) for _ in range(80))
    marked = lambda: " | ".join("%06x" % rng.randrange(16**6) for _ in range(80))
    rows = [(i, plain(), "en", "plain", 1) for i in range(150)] + [(900, marked(), "en", "plain", 1)]
    rows += [(1000 + i, marked(), "en", "tables", 1) for i in range(150)] + [(2000, marked(), "en", "few", 1), (2001, plain(), "en", "few", 1)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not kept[900] and all(v for k, v in kept.items() if k not in (900, 2000))


def expected_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - most * sum(sizes[s] for s in full)
        level = rest / sum(w[s] for s in order if s not in full) if len(full) < len(order) else 0
        over = {s for s in order if s not in full and w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in order}
        full |= over


def test_mixture(spark):
    rows = documents(7, 900)
    frame = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "size").repartition(6)
    got = mixing.mixture(frame).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    target = expected_targets(dict(totals))
    taken = Counter()
    for r in got:
        assert (r.size, r.source, r.source_size) == (size[r.doc_id], source[r.doc_id], totals[r.source])
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s, t in target.items():
        # one document of s2 is longer than all others together: with it once and all others twice 17,827 words are open
        assert abs(taken[s] - t) <= (18_000 if s == "s2" else max(0.002 * t, 60))
    # exponential tilt: within a source the rate is a monotone function of the size
    for s in totals:
        rates = [r.rate for r in sorted((r for r in got if r.source == s and r.size), key=lambda r: r.size)]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)
    again = {r.doc_id: r.copies for r in mixing.mixture(frame.repartition(3)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns and Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_quality_with_clashing_columns(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(60 + i)), "en", "a") for i in range(5)] + [(9, None, None, None)]
    plain = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    extra = plain.selectExpr("*", "1 as low_symbol_share", "2 as high_word_length", "'x' as symbol_share", "3 as n_words", "'y' as kept")
    want = {r.doc_id: r.kept for r in quality.judge(plain).collect()}
    got = quality.judge(extra)
    assert {r.doc_id: r.kept for r in got.collect()} == want
    assert {"low_symbol_share", "high_word_length"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
