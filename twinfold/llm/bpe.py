"""Byte-level BPE by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one encoding, so it is enough to store its
last token.  An automaton over the vocabulary lists the tokens that end at each
position, longest first; a token is the last one of the prefix when it can
stand after the last token of the prefix before it.  Two tokens can stand next
to each other when no merge across their border would have come before the
merges that built them.  Back-pointers then give the ids.

Texts are read whole.  A piece (what the split pattern yields) is encoded once
and remembered in a cache bounded by bytes.  The tokenizer file is read on the
driver and broadcast: it is a model of a few megabytes and does not grow with
the data.  :func:`round_trip` encodes and decodes in one Python stage with one
model; :func:`decode` alone loads only the bytes of the tokens.

Nulls and empty texts have no tokens.  Repeated rows are encoded each for
itself.  An empty table gives an empty result.  Columns named like the
results are replaced, others carried along.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinfold.llm.bytestext import small_batches

# Fixed value: the published split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHED_BYTES = 24 << 20  # of each half of the piece cache
_CACHED_LENGTH = 64  # longer pieces are encoded each time
_CACHED_PAIRS = 1 << 18
_ENTRY = 200  # bytes of a cached piece besides its letters and ids
_NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The published one-letter names of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Decoder:
    """The bytes of each token."""

    def __init__(self, spec: dict):
        value = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        known = {i: bytes(value[c] for c in name) for name, i in spec["model"]["vocab"].items() if name not in self.special}
        known.update((i, name.encode()) for name, i in self.special.items())
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


class BpeModel(Decoder):
    """A tokenizer file, ready to encode and decode."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.letters = byte_letters()
        self.rank: dict[int, int] = {}  # of the merge of two tokens, by left << 32 | right
        # of each token: its parts and the rank of the merge that makes it, -1 for a single byte
        self.left, self.right, self.made = (array("i", [-1]) * len(self.bytes) for _ in range(3))
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.rank[left << 32 | right] = rank
            if self.made[token] < 0:
                self.left[token], self.right[token], self.made[token] = left, right, rank
        self.automaton = ahocorasick.Automaton()
        for name, token in vocab.items():
            if self.made[token] >= 0 or len(name) == 1:
                self.automaton.add_word(name, (token, len(name)))
        self.automaton.make_automaton()
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PATTERN).findall
        self._pairs: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._cached = 0

    def can_follow(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and ``b`` together is encoded as just these two."""
        known = self._pairs.get(a << 32 | b)
        if known is None:
            if len(self._pairs) >= _CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[a << 32 | b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        """Undoes the merges of both, the latest first, and looks for one across the border that would have come before."""
        a_ends = b_ends = _NEVER
        while True:
            across = self.rank.get(a << 32 | b, _NEVER)
            # of equal merges the leftmost comes first: the one inside a before, the one inside b after the border's
            if across < a_ends and across <= b_ends and across < _NEVER:
                return False
            if self.made[a] < 0 and self.made[b] < 0:
                return True
            if self.made[a] > self.made[b]:
                a_ends, a = self.made[a], self.right[a]
            else:
                b_ends, b = self.made[b], self.left[b]

    def piece_ids(self, piece: str) -> list[int]:
        names = self.letters
        coded = "".join([names[b] for b in piece.encode("utf-8")])
        last, size = [-1] * (len(coded) + 1), [0] * (len(coded) + 1)
        for end, (token, length) in self.automaton.iter(coded):
            end += 1
            if last[end] < 0:
                start = end - length
                if start == 0 or (last[start] >= 0 and self.can_follow(last[start], token)):
                    last[end], size[end] = token, length
        out, at = [], len(coded)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _packed(self, piece: str) -> bytes:
        got = self._older.get(piece) or np.array(self.piece_ids(piece), "<u4").tobytes()
        if len(piece) <= _CACHED_LENGTH:
            self._cached += _ENTRY + len(piece) + len(got)
            if self._cached > _CACHED_BYTES:  # what is in use soon moves over from the older half
                self._older, self._cache, self._cached = self._cache, {}, 0
            self._cache[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        make, out = self._packed, []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else (text,)):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += [self._cache.get(p) or make(p) for p in self.pieces(part)]
        return b"".join(out)


_models: dict[type, tuple[int, Decoder]] = {}


def _model(text: str, kind: type[Decoder]) -> Decoder:
    """One model of each kind for each worker process."""
    if kind not in _models or _models[kind][0] != hash(text):
        _models[kind] = hash(text), kind(json.loads(text))
    return _models[kind][1]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(most, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _run(docs: DataFrame, tokenizer: str, column: str, kind: type[Decoder], drop: tuple[str, ...],
         made: list[T.StructField], make: Callable[[Decoder, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``docs`` without the columns ``drop``, with the columns ``made`` that ``make`` gives for a slice of rows."""
    rest = [c for c in docs.columns if c not in drop and c not in [f.name for f in made]]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    names = [*rest, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value, kind)
        for part in _slices(batches, column):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *make(model, part.column(column))], names)

    read = docs.select(*rest, *([] if column in rest else [column]))
    return read.mapInArrow(run, T.StructType([*docs.select(*rest).schema.fields, *made]))


_IDS = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]


def _encoded(model: BpeModel, texts: pa.Array) -> list[pa.Array]:
    ids = [model.encode(t) if t else b"" for t in texts.to_pylist()]
    return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]


def _decoded(model: Decoder, ids: pa.Array) -> list[pa.Array]:
    return [pa.array([model.decode(x) if x else "" for x in ids.to_pylist()], pa.string())]


def encode(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` (binary: little-endian unsigned 32-bit numbers) and ``n_tokens long``."""
    return _run(docs, tokenizer, text_column, BpeModel, (text_column,), _IDS, _encoded)


def decode(encoded: DataFrame, tokenizer: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """``encoded`` with the decoded text; bytes that are no UTF-8 become the replacement character."""
    return _run(encoded, tokenizer, ids_column, Decoder, (), [T.StructField(text_column, T.StringType())], _decoded)


def round_trip(docs: DataFrame, tokenizer: str, text_column: str = "text", decoded_column: str = "decoded") -> DataFrame:
    """:func:`encode` with the text that the ids decode to in ``decoded_column``, in one pass over the rows."""
    def both(model: BpeModel, texts: pa.Array) -> list[pa.Array]:
        ids, counts = _encoded(model, texts)
        return [ids, counts, *_decoded(model, ids)]

    return _run(docs, tokenizer, text_column, BpeModel, (text_column,), [*_IDS, T.StructField(decoded_column, T.StringType())], both)
