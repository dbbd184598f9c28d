"""From documents to training tokens: toxicity, exact and near copies, source weights, BPE.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept.  Its rows are written as Parquet and read again by the next one,
so a lost executor repeats part of one stage only.  All stages but the last
return the columns of ``documents``; after the fourth a document stands there
as often as the mixture takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import bpe, exact, minhash, mixing, toxicity
from twinfold.llm.queries import tokenizer_path
from twinfold.sources.lineage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of the labels that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_score(docs, model, score_column="__toxicity")
    return scored.filter(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, same_text``: token ids, and whether they decode to the text."""
    tokenizer = bpe.read_tokenizer(tokenizer_path())
    hashed = docs.select("doc_id", "lang", "source", "text", exact.text_digest(F.col("text")).alias("digest"))
    coded = bpe.round_trip(hashed, tokenizer)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", (exact.text_digest(F.col("decoded")) == F.col("digest")).alias("same_text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]

#: A trained classifier and an iterative solution are in it: tests/llm compares with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
