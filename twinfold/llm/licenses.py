"""Search for short license notices that may be misspelt.

A text is reduced to its lower-cased words.  A notice that occurs with at most
``k`` edits contains one of its ``k + 1`` pieces unchanged (pigeonhole), so exact
finds of the pieces give all candidate places; there the bounded-error matching
of the ``regex`` library verifies the edits and gives the span.  Words that tell
one license from another (a name, a version) must be unchanged.

Phrases are notices without any error: their places are counted exactly.

Defined results: null and empty texts have no words and no matches.  Whole
texts are searched.  Repeated rows are searched each for itself, an empty table
gives an empty result, extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    exact: tuple[str, ...]  # words that a match must contain unchanged
    errors: int

    def pieces(self) -> list[tuple[int, str]]:
        """``errors + 1`` pieces that make up the notice, with their places."""
        n = self.errors + 1
        cuts = [len(self.words) * i // n for i in range(n + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]


# The usual wording of short notices.
NOTICES = (
    Notice("under the mit license", "mit", ("mit",), 2),
    Notice("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", (), 8),
    Notice("apache license version 2", "apache-2", ("apache", "2"), 2),
    Notice("licensed under the apache license", "apache", ("apache",), 3),
    Notice("creative commons attribution noncommercial", "cc-by-nc", (), 4),
    Notice("licensed under cc by nc", "cc-by-nc", ("cc", "by", "nc"), 2),
    Notice("licensed under cc by sa", "cc-by-sa", ("cc", "by", "sa"), 2),
    Notice("licensed under the gnu general public license", "gpl", ("gnu",), 4),
    Notice("licensed under the gnu lesser general public license", "lgpl", ("gnu", "lesser"), 4),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", (), 8),
    Notice("under the mozilla public license", "mpl", ("mozilla",), 3),
)

_MATCH = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("phrase", T.BooleanType()), T.StructField("first_word", T.LongType()),
    T.StructField("words", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("similarity", T.DoubleType())])
_ARROW_MATCH = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int64()),
                                   ("edits", pa.int64()), ("similarity", pa.float64())]))


class Searcher:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: Sequence[Notice] = NOTICES):
        every = [*(Notice(p, label, (), 0) for p, label in phrases.items()), *notices]
        # (?e): the match with the fewest errors; words are parted by one space
        self.notices = [(n, n.pieces(), regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.words)}){{e<={n.errors}}}(?= )"), set(n.exact))
                        for n in every]

    @staticmethod
    def windows(joined: str, notice: Notice, pieces: list[tuple[int, str]]) -> list[list[int]]:
        """Where the notice could stand, as disjoint stretches of the text."""
        k, spans, out = notice.errors, [], []
        for offset, piece in pieces:
            at = joined.find(piece)
            while at >= 0:
                spans.append((at - offset - k - 1, at - offset + len(notice.words) + k + 1))
                at = joined.find(piece, at + 1)
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([max(0, a), b])
        return out

    def search(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of words; matches in the order of phrases and notices."""
        words = _WORD.findall((text or "").translate(_LOWER))
        joined, found = f" {' '.join(words)} ", []
        for notice, pieces, pattern, exact in self.notices:
            for a, b in self.windows(joined, notice, pieces):
                at = a
                while hit := pattern.search(joined, at, b):
                    # places of a phrase may overlap, spans of a notice with errors do not
                    at = max(hit.start() + 1, hit.end() if notice.errors else 0)
                    body = hit.group()
                    if exact <= set(body.split()):
                        edits = sum(hit.fuzzy_counts)
                        first = joined.count(" ", 0, hit.start() + len(body) - len(body.lstrip())) - 1
                        found.append({"label": notice.label, "phrase": not notice.errors, "first_word": first, "words": len(body.split()),
                                      "edits": edits, "similarity": 1 - edits / len(notice.words)})
        return len(words), found


def find_notices(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: Sequence[Notice] = NOTICES, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words long`` and ``matches array<struct>`` (word spans, edits, similarity)."""
    rest = [c for c in docs.columns if c not in (text_column, "n_words", "matches")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(phrases, notices)
        for batch in batches:
            got = [searcher.search(t.as_py()) for t in batch.column(text_column)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], _ARROW_MATCH)],
                [*rest, "n_words", "matches"])

    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(_MATCH))])
    return docs.select(*rest, text_column).mapInArrow(run, schema)
