import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from twinfold.llm import quality_pu
from twinfold.llm.bytestext import chunks


def good_text(rng):
    return "\n".join(" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(5, 14))).capitalize() + "."
                     for _ in range(rng.randint(2, 9)))


def bad_text(rng):
    text, kind = good_text(rng), rng.randrange(3)
    if kind == 0:
        return text.upper().replace(" ", "!! ")
    return (text.split("\n")[0] + "\n") * 12 if kind == 1 else text.replace(" ", " | ").replace(".", "$$ ")


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    good = [rng.random() < 0.8 for _ in range(1500)]
    texts = [good_text(rng) if g else bad_text(rng) for g in good]
    labels = [(i, int(g)) for i, g in enumerate(good) if rng.random() < 0.5]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1), (3, None), (10**9, 1)], "doc_id long, quality int"), good


def test_verdicts_on_held_out_texts(table):
    docs, labels, good = table
    model = quality_pu.fit(docs, labels)
    assert abs(model.prior - 0.8) < 0.08
    rows = quality_pu.with_score(docs, model).withColumn("held", quality_pu.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held]
    assert np.mean([(r.score >= quality_pu.CUT) == good[r.doc_id] for r in held]) > 0.96


def test_bad_labels_and_held_out_labels_teach_nothing(table, spark):
    docs, labels, _ = table
    kept = labels.filter("quality = 1").filter(~quality_pu.held_out())
    first, second = quality_pu.fit(docs, labels), quality_pu.fit(docs.repartition(5), kept.repartition(3))
    assert np.array_equal(first.weights, second.weights) and first.bias == second.bias


def test_strange_rows(table, spark):
    docs, labels, _ = table
    model = quality_pu.fit(docs, labels, positives=50, unlabelled=100)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, " \n\n\t"), (3, "word " * 100_000), (4, "\n" * 5000), (5, "é" * 3)], "doc_id long, text string")
    rows = quality_pu.with_score(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip() and r.text != "\n" * 5000 and r.text != " \n\n\t"}) == 1
    for d, l in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.filter("quality = 0"))):
        none = quality_pu.fit(d, l)
        assert [r.score for r in quality_pu.with_score(odd.limit(2), none).collect()] == [0.5, 0.5]
    assert quality_pu.with_score(docs.limit(0), model).collect() == []


def plain_traits(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    raw, n = text.encode(), max(1, len(words))
    lines = [x for x in re.split("\n", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = list(zip(low, low[1:], low[2:]))
    letters = max(1, len(re.findall("[A-Za-z]", text)))
    symbols, marks = r"[#*$%&|<>{}\[\]\\^~=_@+/]", r"[!-/:-@\[-`{-~]"
    size = max(1, len(raw))
    return [np.log1p(len(words)), sum(len(w.encode()) for w in words) / n, len(set(low)) / n, 1 - len(set(runs)) / len(runs) if runs else 0,
            (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
            np.log1p(len(words) / (1 + len(re.findall("[.!?]", text)))), len(re.findall("[A-Z]", text)) / letters,
            sum(len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z]", w) for w in words) / n, len(re.findall("[0-9]", text)) / size,
            len(re.findall(symbols, text)) / size, sum(bool(re.search(symbols, w)) for w in words) / n, len(re.findall("[!?]", text)) / n,
            len(re.findall(marks, text)) / size, sum(re.fullmatch(f"{marks}+", w) is not None for w in words) / n, sum(b > 127 for b in raw) / size]


def test_traits_equal_plain_ones():
    rng = random.Random(8)
    parts = ["the", "The", "THE", " ", "  ", "\n", "\n", "\t", "é", "x|y", "##", "12", "!", "?", ".", "—", "Q", "a b c d e", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.choice((0, 1, 4, 60)))) for _ in range(120)]
    texts = [*texts, "", "", *(good_text(rng) for _ in range(5)), *(bad_text(rng) for _ in range(5)), "\n", ""]
    got = np.concatenate([quality_pu.traits(c) for _, c in chunks(pa.array(texts), most=700)])
    assert np.allclose(got, [plain_traits(t) for t in texts])
    assert np.allclose(quality_pu.traits(next(chunks(pa.array(["", ""])))[1]), [plain_traits("")] * 2)


def test_risk_of_the_bad_texts_stays_non_negative():
    """With a prior far too high the plain unbiased risk falls without end; the corrected one does not."""
    rng = np.random.default_rng(1)
    good, mixed = rng.integers(0, 2, (200, 1)), rng.integers(0, 4, (400, 1))
    weights, bias = quality_pu.train_nonnegative(good, mixed, 4, 0.95, steps=2000, ridge=0.0)
    g, u = weights[good].sum(1) + bias, weights[mixed].sum(1) + bias
    assert np.logaddexp(0, u).mean() - 0.95 * np.logaddexp(0, g).mean() > -0.2
