"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; the other side is unlabelled web
text, good and bad mixed.  With the share ``prior`` of good texts in it, the risk
of a classifier g under a loss l is

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

where the second term is the risk on the bad texts, estimated without bias from
the two samples and kept from falling below 0 (where it would, the step goes back
up).  The prior is estimated from the same two samples: any set of texts holds at
least ``prior`` times as large a share of the unlabelled ones as of the good ones,
so the smallest ratio over the sets ``g >= t`` of a first classifier bounds it;
both shares are taken on texts that the first classifier was not fitted on.  At
last all outputs are shifted so that the score ``CUT`` is the one at which the
unbiased estimate of wrong verdicts is least.

The classifier is additive: a logistic model over the bins of shares and counts
that describe the writing of a text (capitals, symbols, repetitions, lengths of
words, lines and sentences).

Fitted on about ``positives`` labelled and ``unlabelled`` other texts (all, where
there are fewer), chosen by a hash of the id: that bounds what the driver gets.
Every text is scored.

Nulls: a null or empty text has no words and is scored like any other.  Null
labels, null ids and labels of unknown texts are left out; of several labels of
one text the lowest counts.  Without positives or without texts the score is 0.5.
Repeated rows are scored alike.  Empty tables give empty results.  Extra columns
are carried along by :func:`with_score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.bytestext import Chunk, chunks, constants, mix, small_batches
from twinfold.sources.lineage import stored

POSITIVES, UNLABELLED = 5_000, 10_000
BINS = 16
CUT = 0.7  # the score from which a text is called good


def _bytes(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members]] = True
    return out


_UPPER, _LOWER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SYMBOL = _bytes("0123456789"), _bytes("#*$%&|<>{}[]\\^~=_@+/")
_STOP, _SHOUT, _BREAK = _bytes(".!?"), _bytes("!?"), _bytes("\n")
_MARK = _bytes("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

TRAITS = ("log_words", "word_bytes", "distinct_share", "repeated_run_share", "repeated_line_share", "line_words", "sentence_words", "upper_share",
          "upper_word_share", "digit_share", "symbol_share", "symbol_word_share", "shout_share", "mark_share", "bare_mark_share", "other_share")


def _per_text(chunk: Chunk, number: np.ndarray) -> np.ndarray:
    """Sums of one number a byte."""
    sums = np.concatenate(([0], np.cumsum(number, dtype=np.int64)))
    return sums[chunk.bounds[1:]] - sums[chunk.bounds[:-1]]


def _distinct(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each text has."""
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return np.bincount(t[new], minlength=n)


def traits(chunk: Chunk) -> np.ndarray:
    """One row of :data:`TRAITS` for each text."""
    n, raw = len(chunk.bounds) - 1, chunk.raw
    words = np.diff(chunk.word_bounds)
    text = np.repeat(np.arange(n), words)
    hashes = chunk.word_hashes()
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(chunk.bounds), 1)

    def in_words(members: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(members[raw], dtype=np.int64)))
        return sums[chunk.end] - sums[chunk.start]

    upper, lower, marks = in_words(_UPPER), in_words(_LOWER), in_words(_MARK)
    letters = np.maximum(np.bincount(text, upper + lower, n), 1)
    length = chunk.end - chunk.start
    key = constants(3, 31)
    run = mix(hashes[:-2] * key[0] + hashes[1:-1] * key[1] + hashes[2:] * key[2]) if len(hashes) > 2 else hashes[:0]
    inside = text[:-2] == text[2:] if len(text) > 2 else np.zeros(0, bool)
    runs = np.bincount(text[:-2][inside], minlength=n) if len(inside) else np.zeros(n, np.int64)

    # lines: from each break or beginning of a text to the next break or its end
    cut = np.flatnonzero(_BREAK[raw])
    first = np.unique(np.concatenate((chunk.bounds[:-1], cut + 1)))
    first = first[first < len(raw)]
    last = np.append(first[1:], len(raw))[: len(first)]
    last = np.where(_BREAK[raw[last - 1]], last - 1, last) if len(last) else last
    full = np.searchsorted(chunk.start, last) > np.searchsorted(chunk.start, first)
    line_text = np.searchsorted(chunk.bounds, first[full], "right") - 1
    lines = np.bincount(line_text, minlength=n)
    line_kinds = _distinct(line_text, chunk.span_hashes(first[full], last[full]), n)

    return np.stack([
        np.log1p(words), np.bincount(text, length, n) / some, _distinct(text, hashes, n) / some,
        1 - _distinct(text[:-2][inside], run[inside], n) / np.maximum(runs, 1) * (runs > 0) - (runs == 0),
        (lines - line_kinds) / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)), np.log1p(words / (1 + _per_text(chunk, _STOP[raw]))),
        np.bincount(text, upper, n) / letters, np.bincount(text, (upper > 1) & (lower == 0), n) / some, _per_text(chunk, _DIGIT[raw]) / size,
        _per_text(chunk, _SYMBOL[raw]) / size, np.bincount(text, in_words(_SYMBOL) > 0, n) / some, _per_text(chunk, _SHOUT[raw]) / some,
        _per_text(chunk, _MARK[raw]) / size, np.bincount(text, marks == length, n) / some, _per_text(chunk, raw >= 128) / size,
    ], 1).astype(np.float64)


@dataclass(frozen=True)
class QualityModel:
    edges: np.ndarray  # a row of bin borders for each trait
    weights: np.ndarray  # a row of bin weights for each trait
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, borders in enumerate(self.edges):
            z += self.weights[j, np.searchsorted(borders, x[:, j], "left")]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.logits(x)))


def _edges(x: np.ndarray) -> np.ndarray:
    """Borders between bins: quantiles of the values, and of the upper tail, where shares that are mostly 0 differ."""
    half = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    return np.quantile(x, np.sort(np.concatenate((half, 1 - 0.5 ** np.arange(1, BINS // 2 + 1)))), axis=0, method="lower").T


def _design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of each value's bin among the bins of all traits."""
    width = edges.shape[1] + 1
    return np.stack([np.searchsorted(b, x[:, j], "left") + j * width for j, b in enumerate(edges)], 1)


def train_nonnegative(good: np.ndarray, mixed: np.ndarray, n_bins: int, prior: float, steps: int = 500, ridge: float = 2e-4,
                      rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk under the logistic loss (steps of Adam); rows are bin numbers."""
    theta = np.zeros(n_bins + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def outputs(rows: np.ndarray) -> np.ndarray:
        return theta[:-1][rows].sum(1) + theta[-1]

    def gradient(rows: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(rows.ravel(), np.repeat(each, rows.shape[1]), n_bins), each.sum()) / len(rows)

    for t in range(1, steps + 1):
        p, u = outputs(good), outputs(mixed)
        bad_risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        up_p, up_u = 0.5 * (1 + np.tanh(0.5 * p)), 0.5 * (1 + np.tanh(0.5 * u))  # slopes of l(-g)
        bad = gradient(mixed, up_u) - prior * gradient(good, up_p)
        grad = prior * gradient(good, up_p - 1) + bad if bad_risk >= 0 else -bad
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def estimated_prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """The share of good texts among the mixed ones, from the scores of both: the smallest ratio of their shares above any score.

    Scores that few good texts reach do not count: chance would decide there.
    """
    cuts = np.unique(np.quantile(good, np.linspace(0.02, 0.5, 49), method="lower"))
    p = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    u = 1 - np.searchsorted(np.sort(mixed), cuts) / len(mixed)
    return float(np.clip((u / p).min(initial=1.0), 0.01, 0.99))


def least_error_cut(good: np.ndarray, mixed: np.ndarray, prior: float) -> float:
    """The score from which texts are best called good: least ``2 * prior * (good texts lost) + (mixed texts kept)``.

    That is the share of wrong verdicts but for a constant.  Of the cuts that chance could set apart as little as
    the best ones, the one that loses fewest good texts.
    """
    cuts = np.unique(np.concatenate([good, mixed]))
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    kept = 1 - np.searchsorted(np.sort(mixed), cuts) / len(mixed)
    error = 2 * prior * lost + kept
    at = int(np.flatnonzero(error <= error.min() + 0.25 / np.sqrt(len(mixed)))[0])
    return float((cuts[at] + cuts[max(at - 1, 0)]) / 2)


def train(good: np.ndarray, mixed: np.ndarray, cut: float = CUT) -> QualityModel:
    """A model from the traits of trusted and of unlabelled texts; from score ``cut`` a text is called good."""
    edges = _edges(np.concatenate([good, mixed]))
    width = edges.shape[1] + 1
    p, u = _design(good, edges), _design(mixed, edges)
    prior = 0.5
    if min(len(good), len(mixed)) > 1:  # each half is scored by a classifier of the other one
        folds = [train_nonnegative(p[k::2], u[k::2], width * len(edges), 0.5) for k in (0, 1)]
        scores = [[w[rows[1 - k::2]].sum(1) + b for k, (w, b) in enumerate(folds)] for rows in (p, u)]
        prior = estimated_prior(*map(np.concatenate, scores))
    weights, bias = train_nonnegative(p, u, width * len(edges), prior)
    # the verdicts at ``cut`` are those of least unbiased error
    bias += np.log(cut / (1 - cut)) - least_error_cut(weights[p].sum(1) + bias, weights[u].sum(1) + bias, prior)
    return QualityModel(edges, weights.reshape(len(edges), width), bias, prior)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def _traits_of(batches: Iterator[pa.RecordBatch], texts: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        rows = [traits(chunk) for _, chunk in chunks(batch.column(texts))]
        yield batch, np.concatenate(rows) if rows else np.zeros((0, len(TRAITS)))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_column: str = "doc_id",
        text_column: str = "text", label_column: str = "quality") -> QualityModel:
    """A model from the texts labelled 1, but for those held out, and from unlabelled texts."""
    small_batches(docs.sparkSession)
    known = (labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column))
             .groupBy(id_column).agg(F.min(F.col(label_column).cast("int")).alias("__label")))
    good = stored(known.filter("__label = 1").select(id_column), "good")
    sizes = {"good": good.count(), "all": docs.count()}

    def part(seed: int, wanted: int, rows: int) -> Column:
        return F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, rows)))

    texts = docs.select(id_column, F.col(text_column).alias("text"))
    some_good = texts.join(good.filter(part(7, positives, sizes["good"])), id_column).select(F.lit(1).alias("good"), "text")
    some = texts.filter(part(8, unlabelled, sizes["all"])).select(F.lit(0).alias("good"), "text")
    sample = stored(some_good.union(some), "pu-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _traits_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("good"), *(pa.array(x[:, j]) for j in range(len(TRAITS)))], ["good", *TRAITS])

    frame = sample.mapInArrow(run, "good int, " + ", ".join(f"{t} double" for t in TRAITS)).toPandas()
    frame = frame.sort_values(list(frame.columns))  # the same model whatever order the rows come in
    x, is_good = frame[list(TRAITS)].to_numpy(), frame["good"].to_numpy() == 1
    if not is_good.any() or is_good.all():
        return QualityModel(np.zeros((len(TRAITS), 0)), np.zeros((len(TRAITS), 1)), 0.0, 0.5)
    return train(x[is_good], x[~is_good])


def with_score(docs: DataFrame, model: QualityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1, in place of a column of that name."""
    docs = docs.drop(score_column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _traits_of(batches, text_column):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], [*names, score_column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())]))
