import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinfold.llm import collocations
from twinfold.llm.bytestext import Chunk, chunks


def brute(rows, top=2000, max_words=4, min_count=30):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i: i + k]) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    inside = {(p[0], *p[i:j]) for p, a in often.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1)
              if j - i < len(p) - 1 and 100 * a >= 80 * f[(p[0], *p[i:j])]}
    out = []
    for lang in {p[0] for p in often}:
        found = []
        for p, a in often.items():
            if p[0] == lang and p not in inside:
                cuts = [(2000000 * a // (f[p[: k + 1]] + f[(lang, *p[k + 1:])]), k, f[p[: k + 1]], f[(lang, *p[k + 1:])]) for k in range(1, len(p) - 1)]
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(p[1:]).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(frame, **options):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(frame, **options).collect())


def test_phrases_equal_plain_counts(spark):
    rng = random.Random(4)
    words = ["the", "The", "of", "é", "strasse", "a-very-long-word-indeed", "a-very-long-ward-indeed", "x", "and", "\x00"]
    fixed = ["the of and x", "x x x x x", "a-very-long-word-indeed of", "é é"]
    texts = []
    for _ in range(160):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.choice((0, 1, 3, 40)))]
        texts.append("".join(p + rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!")) for p in parts))
    rows = [(t, rng.choice(("en", "en", "de", None, "und", ""))) for t in texts]
    rows += [(None, "en"), ("", None), ("x of " * 3000, "en"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "text string, lang string, n string, block int").repartition(3)
    want = brute(rows, min_count=5)
    assert len(want) > 50
    assert mined(frame, min_count=5, block_words=150) == want  # many blocks
    assert mined(frame, min_count=5) == want
    assert mined(frame, min_count=5, top=3, max_words=3) == brute(rows, 3, 3, 5)
    assert mined(frame, min_count=5, max_words=2) == brute(rows, 2000, 2, 5)


def test_nothing_frequent_and_no_rows(spark):
    frame = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert mined(frame) == [] and mined(frame.limit(0)) == [] and mined(frame.filter("text is null")) == []
    assert mined(spark.createDataFrame([("a b. " * 30, None)], "text string, lang string")) == [("und", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    texts = pa.array(["aaa bbb aaa ccccccccccccccccccccc", "cccccccccxccccccccccc aaa"])
    chunk = next(chunks(texts, separators=collocations._SEPARATORS))[1]
    monkeypatch.setattr(Chunk, "word_hashes", lambda self: np.zeros(len(self.start), np.uint64))
    place, kind = collocations._kinds(chunk, np.zeros(6, np.int64))
    assert kind.tolist() == [0, 1, 0, 2, 3, 0] and kind[place].tolist() == [0, 1, 2, 3]


def test_arithmetic_beyond_64_bits(spark):
    big = 2**63 - 1
    row = spark.range(1).select(collocations.cut_score(F.lit(big - 7), F.lit(big), F.lit(big - 3)).alias("s"),
                                collocations.mostly_inside(F.lit(big // 10 * 8), F.lit(big // 10 * 10)).alias("yes"),
                                collocations.mostly_inside(F.lit(big // 10 * 8 - 1), F.lit(big // 10 * 10)).alias("no")).first()
    assert (row.s, row.yes, row.no) == (2_000_000 * (big - 7) // (2 * big - 3), True, False)
