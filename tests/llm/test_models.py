import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from twinfold.llm import bpe, html_crf, licenses, toxicity
from twinfold.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.read_tokenizer(path), Tokenizer.from_file(path)


def strange_texts():
    rng = random.Random(3)
    parts = ["a", "aa", "b", "ab", "the", " ", "  ", "\n", "é", "日本", "<|endoftext|>", "!!", "--", "0", "\t", "'s", "😀", "\x00", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += [rng.choice("aA=- \n!x0") * n for n in range(200)]
    texts += ["".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(60)) for _ in range(100)]
    return [*texts, "", "word " * 30_000, "x" * 20_000]


def test_ids_equal_the_library(tokenizer):
    spec, library = tokenizer
    model = bpe.BpeModel(json.loads(spec))
    for text in strange_texts():
        want = library.encode(text, add_special_tokens=False).ids
        packed = model.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert model.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_a_full_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHED_BYTES", 600)
    monkeypatch.setattr(bpe, "_CACHED_PAIRS", 3)
    spec, library = tokenizer
    model = bpe.BpeModel(json.loads(spec))
    for text in strange_texts()[:150]:
        assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_tables(spark, tokenizer):
    spec, library = tokenizer
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, vocab int, ids string")
    encoded = bpe.encode(frame, spec)
    assert encoded.columns == ["doc_id", "vocab", "ids", "n_tokens"]
    got = sorted((r.doc_id, r.n_tokens, r.text) for r in bpe.decode(encoded, spec).collect())
    assert got == [(1, 2, "Hello world"), (2, 0, ""), (3, 0, ""), (3, 0, "")]
    assert bpe.decode(bpe.encode(frame.limit(0), spec), spec).collect() == []


def test_toxic_texts_and_sentences(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bad = ["zzork" + x for x in "abcdefgh"] + ["vile"]
    docs, labels = [], []
    for i in range(700):
        sentences = [" ".join(word() for _ in range(8)).capitalize() + "." for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] = f"You {rng.choice(bad)} and {rng.choice(bad)} {word()}!"
        docs.append((i, " ".join(sentences), "x", "en"))
        labels.append((i, int(toxic)))
    docs += [(9000, None, "x", "en"), (9001, "", "x", "en"), (9002, "calm words. " * 20_000, "x", "en")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string, lang string").repartition(4)
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (123456, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, marks)
    scored = {r.doc_id: r.score for r in toxicity.with_score(frame, model).collect()}
    held = {r.doc_id for r in frame.filter(toxicity.held_out()).collect()}
    right = [(scored[i] >= 0.5) == bool(t) for i, t in labels if i in held]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert all(0 <= p <= 1 for p in scored.values()) and scored[9000] == scored[9001] == pytest.approx(model.leak) and scored[9002] < 0.5
    found = toxicity.offending_sentences(frame, model).collect()
    assert sum(r.sentence.startswith("You ") for r in found) / len(found) > 0.97
    assert all(dict((d[0], d[1]) for d in docs)[r.doc_id].encode()[r.first_byte:].startswith(r.sentence.encode()) for r in found)
    again = toxicity.fit(frame.repartition(2), marks)
    assert np.array_equal(again.features, model.features) and np.allclose(again.weights, model.weights)


def test_labels_of_one_kind_and_no_documents(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    for label, want in (([(1, 0), (2, 0)], 0.0), ([], 0.0), ([(1, 1), (2, 1), (3, 1)], 1.0)):
        model = toxicity.fit(frame, spark.createDataFrame(label, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.with_score(frame, model).collect()} == {want}
    assert toxicity.with_score(frame.limit(0), model).collect() == []


def test_pages(spark):
    model = html_crf.train()
    extractor, wrong, blocks = html_crf.Extractor(model), 0, 0
    for page in labelled_pages(4, seed=99):
        for block, state in extractor.labelled(page):
            blocks, wrong = blocks + 1, wrong + ((block.label == "main") != bool(state))
    assert blocks > 500 and wrong / blocks < 0.01
    html = ("<html><head><title>t</title><script>var t='</p>'</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1>"
            "<p><b>One&nbsp;two\n three.<br>Four &eacute; five.<p>Second paragraph goes here.</p></article><footer>&copy; us</footer></body></html>")
    rows = [(1, "u", html), (2, "u", None), (3, "u", ""), (4, "u", "<<<>< & <p"), (5, "u", "<article>" + "<p>Long words go on.</p>" * 20_000 + "</article>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_crf.extract(frame, model).collect()}
    assert got[1] == "A & B\n\nOne two three. Four é five.\n\nSecond paragraph goes here."
    assert got[2] == got[3] == "" and got[5].count("\n\n") == 19_999
    assert html_crf.extract(frame.limit(0), model).collect() == []


def test_viterbi_is_the_best_chain():
    rng = random.Random(2)
    model = html_crf.CrfModel({}, ((0.3, -0.7), (-0.2, 0.9)), (0.1, -0.4))
    for n in range(1, 9):
        scores = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(n)]
        value = lambda c: (model.start[c[0]] + sum(scores[i][s] for i, s in enumerate(c))
                           + sum(model.step[a][b] for a, b in zip(c, c[1:])))
        best = max(([k >> i & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert value(html_crf.viterbi(scores, model)) == pytest.approx(value(best))


def edits_within(pattern, text):
    """Least edits between the pattern and any stretch of whole words of the text."""
    words, best = text.split(), 99
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 12) + 1):
            other, row = " ".join(words[i:j]), list(range(len(pattern) + 1))
            if abs(len(other) - len(pattern)) > 6:
                continue
            for c in other:
                new = [row[0] + 1]
                for k, p in enumerate(pattern):
                    new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (c != p)))
                row = new
            best = min(best, row[-1])
    return best


def test_misspelt_notices():
    rng = random.Random(8)
    notice = licenses.Notice("licensed under the gnu general public license", "gpl", (), 4)
    searcher = licenses.Searcher({}, [notice])
    for _ in range(150):
        text = list(notice.words)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(1, len(text) - 1)
            text[at: at + rng.choice([0, 1])] = rng.choice(["", "q", "e"])
        text = "some words " + "".join(text) + " more words"
        n, found = searcher.search(text)
        assert n == len(text.split()) and bool(found) == (edits_within(notice.words, " ".join(text.split())) <= notice.errors)


def test_licenses(spark):
    rows = [(1, "Released under the MIT License. under the mit license"), (2, "released undr the mit licence"), (3, "under the bsd license"),
            (4, "Apache License, Version 2.0; CC BY-NC"), (5, None), (6, ""), (7, "word " * 50_000 + "under\nthe MIT  license"), (8, "éunder the mit license")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, matches int")
    got = {r.doc_id: r for r in licenses.find_notices(frame).collect()}
    phrases = {i: [(m.label, m.first_word) for m in r.matches if m.phrase] for i, r in got.items()}
    assert phrases == {1: [("mit", 1), ("mit", 5)], 2: [], 3: [], 4: [("apache-2", 0), ("cc-by-nc", 5)], 5: [], 6: [], 7: [("mit", 50_000)], 8: []}
    assert [(m.label, m.edits, m.first_word) for m in got[2].matches] == [("mit", 2, 1)] and got[3].matches == []
    assert got[7].n_words == 50_004 and got[5].n_words == got[6].n_words == 0
    assert licenses.find_notices(frame.limit(0)).collect() == []


def test_digest_bytes():
    assert hashlib.sha256(np.array([1, 256], "<u4").tobytes()).digest() == hashlib.sha256(b"\x01\0\0\0\0\x01\0\0").digest()
