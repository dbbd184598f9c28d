"""The pipeline against a brute-force version of its stages, on the smallest tables."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_near_duplicates import components
from test_exact_quality_mixing import expected_targets
from twinfold.llm import toxicity
from twinfold.llm.queries import QUERIES
from twinfold.sources.lineage import stored

SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF_DIR), "stage"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]

    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
    assert ids[1] == sorted(i for i in rows if score[i] < 0.5)
    last = {}
    for i in ids[1]:
        last[rows[i].text or ""] = max(i, last.get(rows[i].text or "", i))
    assert ids[2] == sorted(last.values())
    part = components([(i, rows[i].text) for i in ids[2]])
    assert ids[3] == sorted(i for i in ids[2] if part[i][1] == i) and len(ids[3]) < len(ids[1])

    totals = Counter()
    for i in ids[3]:
        totals[rows[i].source] += words(rows[i].text)
    target, taken = expected_targets(dict(totals)), Counter()
    for i in ids[4]:
        taken[rows[i].source] += words(rows[i].text)
    assert max(Counter(ids[4]).values()) <= 2 and set(ids[4]) <= set(ids[3])
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(words(rows[i].text) for i in ids[3] if rows[i].source == s)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = frames[5].collect()
    assert sorted(r.doc_id for r in out) == ids[4] and all(r.same_text for r in out)
    for r in out:
        want = library.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near-duplicates", "mixing sources", "BPE"]


@pytest.mark.parametrize("name,columns", [
    ("op1_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    ("op2_html_crf", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    ("op5_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op9_licenses", {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
                      "base_labels": "string", "labels": "string", "score": "double"}),
    ("op10_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
])
def test_contract_columns(spark, name, columns):
    out = QUERIES[name](spark, SF_DIR)
    assert columns.items() <= dict(out.dtypes).items()
    key = "page_id" if name == "op2_html_crf" else "doc_id"
    table = "pages" if name == "op2_html_crf" else "documents"
    assert out.select(key).distinct().count() == out.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    if name == "op10_bpe":
        texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("want"))
        assert out.join(texts, "doc_id").filter("want <> decoded_sha256").isEmpty()
