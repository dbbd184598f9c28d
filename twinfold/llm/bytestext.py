"""Words and hashes of a batch of texts as numpy arrays over their UTF-8 bytes.

Words are runs of bytes other than the ASCII white space (space, tab, line
feed, vertical tab, form feed, carriage return) or another set of separators;
A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U64 = np.uint64
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All ASCII but letters and digits, for words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, U64), np.ones(1, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers derived from ``seed``."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTE = constants(256, 11)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.cumprod(np.array([1] + [b] * n, U64), dtype=U64) for b in (_BASE, _INVERSE))
    return _powers


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Rows with whole texts are large: Arrow batches of ``rows`` instead of Spark's 10,000, unless the session has its own number."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(rows))


class Chunk:
    """Some whole texts: bytes as they are and lower-cased, words and their texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE):
        """``bounds``: where the texts begin and end, one more than there are texts."""
        self.raw, self.data, self.bounds = data, LOWER[data], bounds
        body = ~separators[self.data]
        first, last = body.copy(), body.copy()
        first[1:] &= ~body[:-1]
        last[:-1] &= ~body[1:]
        full = bounds[:-1][bounds[1:] > bounds[:-1]]
        first[full] = body[full]
        full = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        last[full] = body[full]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: The words of text i are word_bounds[i]:word_bounds[i + 1].
        self.word_bounds = np.searchsorted(self.start, bounds)
        power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[self.data] * power[: len(data)], out=self._sums[1:])

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal bytes give equal hashes wherever they stand."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(U64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.start, self.end)


def chunks(texts: pa.Array, most: int = 1 << 20, separators: np.ndarray = SPACE) -> Iterator[tuple[int, Chunk]]:
    """The texts (null: empty) in chunks of about ``most`` bytes, with the number of each chunk's first text.

    A longer text is a chunk of its own: it is never cut.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, Chunk(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at], separators)
        at = to


def shingle_sets(chunk: Chunk, size: int) -> list[np.ndarray]:
    """The sorted distinct ``size``-word shingle hashes of each text.

    A text of fewer words has its whole sequence as its only shingle, a text without words none.
    """
    word, key = chunk.word_hashes(), constants(2 * size, 23)
    n = len(word)
    run = np.zeros(max(0, n - size + 1), U64)
    for j in range(size if len(run) else 0):
        run += word[j: n - size + 1 + j] * key[j]
    run, out = mix(run), []
    for a, b in zip(chunk.word_bounds[:-1].tolist(), chunk.word_bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(run[a: b - size + 1]))
        elif b > a:
            out.append(mix((word[a:b] * key[: b - a]).sum(dtype=U64, keepdims=True) + key[size + b - a]))
        else:
            out.append(word[:0])
    return out
