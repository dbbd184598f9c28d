"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  A sentence is scored by a logistic model over its
words and their beginnings; the text's score is the noisy-or of its sentences
and a small leak: ``1 - (1 - leak) * prod(1 - p)``.  The weights are trained from
labels of whole texts, and afterwards tell which sentences offend.  A sentence
without any feature of the model carries no evidence.

The classifier is fitted on a sample of labelled texts: about ``per_class`` of
each label (all, where there are fewer), chosen by a hash of the id.  That bound
and ``max_features`` bound what the driver gets.  Everything is scored.

Nulls: a null or empty text has no sentence and scores the leak.  Null labels
and labels of unknown texts are left out; of several labels of one text the
highest counts.  Without labels of both kinds the score is the share of toxic
ones for every text.  Repeated rows are scored alike.  Empty tables give empty
results.  Extra columns are carried along by :func:`with_score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.bytestext import PUNCTUATION, Chunk, chunks, small_batches
from twinfold.sources.lineage import stored

PREFIXES = (4, 5, 6, 7, 8)  # bytes
MAX_FEATURES = 4096
PER_CLASS = 4000
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    leak: float


def _features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word number and feature hash of each (word, feature)."""
    numbers, hashes = [np.arange(len(chunk.start))], [chunk.word_hashes()]
    for n in PREFIXES:
        long = np.flatnonzero(chunk.end - chunk.start > n)
        numbers.append(long)
        hashes.append(chunk.span_hashes(chunk.start[long], chunk.start[long] + n) ^ np.uint64(n))
    return np.concatenate(numbers), np.concatenate(hashes)


def _sentence_of_word(chunk: Chunk) -> np.ndarray:
    """A number that grows with each sentence and each text."""
    breaks = np.concatenate(([0], np.cumsum(_ENDS[chunk.data])))
    texts = np.searchsorted(chunk.word_bounds, np.arange(len(chunk.start)), "right")
    return breaks[chunk.start] + texts


class _Lookup:
    """Positions of hashes in a sorted array; a bitmap rules nearly all others out first."""

    def __init__(self, features: np.ndarray):
        self.features, self.maybe = features, np.zeros(1 << 20, bool)
        self.maybe[features >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        if not len(at) or not len(self.features):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
        same = self.features[place] == hashes[at]
        return at[same], place[same]


def _sentences(chunk: Chunk, lookup: _Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences with features: text number and first word of each; then sentence and feature of each distinct entry."""
    word, hashes = _features(chunk)
    at, feature = lookup.find(hashes)
    sentence = _sentence_of_word(chunk)
    entries = np.unique(np.stack([sentence[word[at]], feature], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    found, index = np.unique(entries[:, 0], return_inverse=True)
    first_word = np.searchsorted(sentence, found)
    text = np.searchsorted(chunk.word_bounds, first_word, "right") - 1
    return text, first_word, index, entries[:, 1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _chunk_scores(chunk: Chunk, lookup: _Lookup, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text; then text, first word and score of each sentence with features."""
    text, first_word, index, feature = _sentences(chunk, lookup)
    z = model.bias + np.bincount(index, model.weights[feature], len(text))
    clean = np.bincount(text, -np.logaddexp(0, z), len(chunk.bounds) - 1) + np.log1p(-model.leak)
    return -np.expm1(clean), text, first_word, _sigmoid(z)


def train_noisy_or(text: np.ndarray, index: np.ndarray, feature: np.ndarray, label: np.ndarray, weight: np.ndarray,
                   start: np.ndarray, leak: float, steps: int = 600, ridge: float = 0.0004) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of the labels (gradient steps of Adam)."""
    theta = np.append(start, -3.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n, total = len(text), weight.sum()
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(index, theta[feature], n)
        q = np.bincount(text, -np.logaddexp(0, z), len(label)) + np.log1p(-leak)
        clean = np.exp(q)
        # the loss is -log(1 - clean) for a toxic text and -q for a clean one, and dq/dz is -p
        dq = np.where(label, clean / np.maximum(1 - clean, 1e-9), -1.0) * weight
        dz = -dq[text] * _sigmoid(z)
        grad = np.append(np.bincount(feature, dz[index], len(theta) - 1), dz.sum()) / total
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def _labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_column: str, text_column: str,
                     label_column: str) -> tuple[DataFrame, dict[int, int]]:
    known = (labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column))
             .groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("__label")))
    known = stored(known, "labels")
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64(id_column, F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.lit(False)
    for value in (0, 1):
        chosen = chosen | ((F.col("__label") == value) & (part < per_class / max(1, counts.get(value, 0))))
    ids = stored(known.filter(chosen), "label-sample")
    texts = (docs.select(id_column, text_column).join(ids, id_column)
             .select(F.col(text_column).alias("text"), F.col("__label").alias("label")))
    return stored(texts, "labelled-texts"), counts


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_features: int = MAX_FEATURES,
        id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """A model from labels of texts that are not held out."""
    small_batches(docs.sparkSession)
    sample, counts = _labelled_sample(docs, labels, per_class, id_column, text_column, label_column)
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    none = np.zeros(0)
    if not toxic or not clean:
        return ToxicityModel(none.astype(np.uint64), none, 0.0, toxic / max(1, toxic + clean))

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for at, chunk in chunks(batch.column("text"), separators=PUNCTUATION):
                word, hashes = _features(chunk)
                text = np.searchsorted(chunk.word_bounds, word, "right") - 1
                order = np.lexsort((text, hashes))
                h, t = hashes[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                h, y = h[new], label[at + t[new]]
                values, index = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(np.bincount(index, y, len(values)).astype(np.int64)),
                     pa.array(np.bincount(index, minlength=len(values)).astype(np.int64))], ["feature", "toxic", "all"])

    found = (sample.mapInArrow(document_counts, "feature long, toxic long, all long").groupBy("feature")
             .agg(F.sum("toxic").alias("a"), (F.sum("all") - F.sum("toxic")).alias("b")))
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = float(size.get(1, 0)), float(size.get(0, 0))
    ratio = F.log((F.col("a") + 0.5) / (p + 1)) - F.log((F.col("b") + 0.5) / (n + 1))
    # how far the ratio is from what chance gives, in standard errors
    sure = ratio / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = (found.filter("a >= 3").withColumn("ratio", ratio).withColumn("sure", sure).filter((F.col("ratio") > 1.5) & (F.col("sure") > 2))
            .orderBy(F.desc("sure"), "feature").limit(max_features).select("feature", "ratio").toPandas())
    features = best["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(features)
    features, start = features[order], best["ratio"].to_numpy(float)[order] * 0.5

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(features)
        for batch in batches:
            label = batch.column("label").to_pylist()
            for at, chunk in chunks(batch.column("text"), separators=PUNCTUATION):
                text, _, index, feature = _sentences(chunk, lookup)
                bags: list[list[list[int]]] = [[] for _ in range(len(chunk.bounds) - 1)]
                parts = np.split(feature, np.searchsorted(index, np.arange(1, len(text)))) if len(text) else []
                for t, part in zip(text.tolist(), parts):
                    bags[t].append(part.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(label[at: at + len(bags)], pa.int32()),
                                                  pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["label", "bag"])

    rows = sample.mapInArrow(entries, "label int, bag array<array<int>>").collect()
    rows.sort(key=lambda r: (r["label"], r["bag"]))  # the same model whatever order the rows come in
    label = np.array([r["label"] for r in rows], bool)
    bags = [s for r in rows for s in r["bag"]]
    text = np.repeat(np.arange(len(rows)), [len(r["bag"]) for r in rows])
    index = np.repeat(np.arange(len(bags)), [len(s) for s in bags])
    feature = np.fromiter((f for s in bags for f in s), np.int64)
    weight = np.where(label, toxic / max(1, label.sum()), clean / max(1, (~label).sum()))
    # toxic texts without any known feature are what the leak explains
    silent = np.bincount(text, minlength=len(rows)) == 0
    leak = float(np.clip((weight * (label & silent)).sum() / max(1.0, (weight * silent).sum()), 1e-4, 0.2))
    weights, bias = train_noisy_or(text, index, feature, label, weight, start, leak)
    return ToxicityModel(features, weights, bias, leak)


def with_score(docs: DataFrame, model: ToxicityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1, in place of a column of that name."""
    docs = docs.drop(score_column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(model.features)
        for batch in batches:
            scores = [_chunk_scores(c, lookup, model)[0] for _, c in chunks(batch.column(text_column), separators=PUNCTUATION)]
            column = pa.array(np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, score_column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())]))


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """``<id>, first_byte, sentence, score`` of the sentences that score ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(model.features)
        for batch in batches:
            ids, out = batch.column(id_column).to_pylist(), []
            raw = [(t or "").encode() for t in batch.column(text_column).to_pylist()]
            for at, chunk in chunks(batch.column(text_column), separators=PUNCTUATION):
                _, text, word, score = _chunk_scores(chunk, lookup, model)
                for t, w, s in zip(text.tolist(), word.tolist(), score.tolist()):
                    if s >= threshold:
                        body, start = raw[at + t], int(chunk.start[w] - chunk.bounds[t])
                        end = start + int(np.argmax(np.append(_ENDS[np.frombuffer(body, np.uint8)[start:]], True)))
                        out.append((ids[at + t], start, body[start:end].decode("utf-8", "replace"), s))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [batch.schema.field(id_column).type, pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [id_column, "first_byte", "sentence", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, first_byte long, sentence string, score double")
