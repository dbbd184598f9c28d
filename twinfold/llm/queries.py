"""The registered queries of this package and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import audit, bpe, collocations, exact, html_crf, licenses, lines, minhash, mixing, quality, quality_pu, quotes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@_query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


@_query("op2_html_crf")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_crf.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), html_crf.train())
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


@_query("op3_minhash", minhash.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op4_quotes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "body", "n_quotes", "n_linked", "reply_to", "thread", "position")


@_query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op6_quality", quality.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op7_lines")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), runs=True)


@_query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copy_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op9_licenses")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_notices(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["phrase"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    starts = F.transform(base, lambda m: m["first_word"])
    score = F.array_max(F.transform("matches", lambda m: m["similarity"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"))


@_query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.read_tokenizer(tokenizer_path())
    coded = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op11_quality_pu")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_pu.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_pu.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_pu.held_out().alias("held_out"), "score", (F.col("score") >= quality_pu.CUT).cast("int").alias("predicted"))


@_query("op12_collocations", collocations.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@_query("op13_audit", audit.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
