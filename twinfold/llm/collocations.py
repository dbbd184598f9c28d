"""Phrases mined by SETM: sorted occurrence relations, merge joins and group counts.

A piece of text is a row of words.  The occurrence relation of length k holds, in
the order of texts, pieces and positions, which phrase of k words begins at each
position.  It is kept in blocks of about ``BLOCK_WORDS`` words, as arrays of
numbers that count the phrases of the block; 0 is a gap.

* Length 1 is read from the texts and stored.
* A phrase of k + 1 words is two phrases of k words at adjacent positions of a
  piece.  Within a block, the merge join of the relation with itself is a look at
  the next position, since the relation is sorted.
* Each block counts its phrases (``left, right, n``); one shuffle brings the counts
  of a phrase together, at most one row a block, and only phrases with
  ``min_count`` occurrences go back to their blocks.
* There the relation is semi-joined with them before it is extended.

Every phrase of a frequent one is frequent, so the counts of all parts of a phrase
are at hand: those of its beginnings come from the phrase without its last word,
those of its ends from the one without its first.  Phrases are told apart by the
numbers of their parts and words by their letters; hashes only group the words of a
chunk, and equal hashes of different words are found out.

Nulls: a null text is empty; a null language is ``und``.  Repeated rows count as
often as they stand there.  Long texts are read whole.  An empty table, or one
without frequent phrases, gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.bytestext import Chunk, chunks, constants, mix, small_batches
from twinfold.sources.lineage import stored

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2_000
BLOCK_WORDS = 3_000_000
_BREAKS = np.zeros(256, bool)
_BREAKS[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True
_BLOCKS = 1 << 12  # of one partition at most: 8 billion words
_CODES = 1 << 31  # numbers of a block at most


def _ends(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 8 bytes of each word, shorter words filled up with zeros."""
    size = chunk.end - chunk.start
    padded = np.concatenate([np.zeros(8, np.uint8), chunk.data, np.zeros(8, np.uint8)])
    at = np.ndarray(len(padded) - 7, "<u8", padded.tobytes(), strides=(1,))
    spare = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
    return at[chunk.start + 8] << spare, at[chunk.end] >> spare


def _kinds(chunk: Chunk, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct (language, word) of a chunk, and the number of each word's kind among them."""
    key = mix(chunk.word_hashes() + lang.astype(np.uint64) * constants(1, 61)[0])
    _, place, kind = np.unique(key, return_index=True, return_inverse=True)
    like = place[kind]
    size = chunk.end - chunk.start
    first, last = _ends(chunk)
    same = (lang == lang[like]) & (size == size[like]) & (first == first[like]) & (last == last[like])
    body = chunk.data.tobytes()
    if same.all() and all(body[chunk.start[i]: chunk.end[i]] == body[chunk.start[j]: chunk.end[j]] for i, j in _pairs(like, size > 16)):
        return place, kind
    known: dict[tuple[int, bytes], int] = {}  # two words of one hash
    kind = np.array([known.setdefault((g, body[a:b]), len(known)) for g, a, b in zip(lang.tolist(), chunk.start, chunk.end)])
    return np.unique(kind, return_index=True)[1], kind


def _pairs(like: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(wanted & (like != np.arange(len(like))))
    return zip(at.tolist(), like[at].tolist())


def _with_gaps(codes: np.ndarray, chunk: Chunk) -> np.ndarray:
    """The numbers of the words with a 0 wherever another piece or text begins."""
    breaks = np.concatenate(([0], np.cumsum(_BREAKS[chunk.data])))
    piece = breaks[chunk.start] + np.repeat(np.arange(len(chunk.bounds) - 1), np.diff(chunk.word_bounds))
    out = np.zeros(len(codes) + int((np.diff(piece) > 0).sum()) if len(codes) else 0, np.int32)
    if len(codes):
        out[np.arange(len(codes)) + np.concatenate(([0], np.cumsum(np.diff(piece) > 0)))] = codes
    return out


_READ = "block long, codes array<int>, place long, lang string, word string, n long"


def _table(rows: int, names: list[str], kinds: list[pa.DataType], given: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(rows, k)) for c, k in zip(names, kinds)], names)


def word_occurrences(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The relation of length 1: rows ``block, codes`` and, for each word of a block, ``place, lang, word, n``."""
    names = ["block", "codes", "place", "lang", "word", "n"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * _BLOCKS
        done, words, known, counts = 0, 0, {}, []

        def vocabulary() -> Iterator[pa.RecordBatch]:
            n = np.bincount(np.concatenate(counts), minlength=len(known) + 1)[1:]
            entries = list(known)
            for at in range(0, len(entries), 1 << 16):
                some = entries[at: at + (1 << 16)]
                yield _table(len(some), names, kinds, {
                    "place": pa.array((first + done) * _CODES + np.arange(at + 1, at + 1 + len(some))),
                    "lang": pa.array([g for g, _ in some], pa.string()), "word": pa.array([w.decode("utf-8", "replace") for _, w in some], pa.string()),
                    "n": pa.array(n[at: at + len(some)])})

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            numbers = {g: i for i, g in enumerate(dict.fromkeys(langs))}
            of_text = np.array([numbers[g] for g in langs], np.int64)
            named = list(numbers)
            for at, chunk in chunks(batch.column("text"), separators=_SEPARATORS):
                lang = np.repeat(of_text[at: at + len(chunk.bounds) - 1], np.diff(chunk.word_bounds))
                if not len(lang):
                    continue
                place, kind = _kinds(chunk, lang)
                body = chunk.data.tobytes()
                codes = np.array([known.setdefault((named[g], body[a:b]), len(known) + 1)
                                  for g, a, b in zip(lang[place].tolist(), chunk.start[place].tolist(), chunk.end[place].tolist())], np.int32)[kind]
                counts.append(codes)
                row = pa.ListArray.from_arrays(pa.array([0, len(full := _with_gaps(codes, chunk))], pa.int32()), pa.array(full))
                yield _table(1, names, kinds, {"block": pa.array([first + done]), "codes": row})
                words += len(codes)
                if words >= block_words:
                    yield from vocabulary()
                    done, words, known, counts = done + 1, 0, {}, []
                    if done == _BLOCKS:
                        raise ValueError("a partition of more than 8 billion words: repartition the texts")
        if words:
            yield from vocabulary()

    read = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    return read.mapInArrow(run, _READ)


def frequent(keys: DataFrame, by: list[str], min_count: int) -> DataFrame:
    """The rows ``place, <by>, n`` of the groups of ``min_count`` and more, with ``id`` and count ``a`` of the group.

    A place is a block and a number in it.  A group has at most one row a block, so no group is large.  Its id is
    its smallest place.
    """
    group = Window.partitionBy(*by)
    return (keys.withColumn("a", F.sum("n").over(group)).withColumn("id", F.min("place").over(group)).filter(F.col("a") >= min_count)
            .select("place", *by, "id", "a", (F.col("id") == F.col("place")).alias("first")))


def _by_block(kept: DataFrame, step: int) -> DataFrame:
    """``block, step, code, id``: for each block the numbers of its frequent groups and their ids, as arrays."""
    return (kept.groupBy(F.shiftright("place", 31).alias("block"))
            .agg(F.collect_list(F.col("place").bitwiseAND(F.lit(_CODES - 1)).cast("int")).alias("code"), F.collect_list("id").alias("id"))
            .select("block", F.lit(step).alias("step"), "code", "id"))


def _next_lengths(codes: list[np.ndarray], key_of: np.ndarray, positions: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Left and right number of each distinct adjacent pair of kept numbers; the pairs by position, if asked for; their counts."""
    found, places = [], []
    for c in codes:
        kept = np.where(key_of[c] > 0, c, 0)
        place = np.flatnonzero((kept[:-1] > 0) & (kept[1:] > 0))
        places.append((len(c) - 1, place))
        found.append((kept[place].astype(np.int64) << 32) | kept[place + 1])
    sizes = [len(f) for f in found]
    joined = np.concatenate(found) if found else np.zeros(0, np.int64)
    del found
    if not positions:
        values, n = np.unique(joined, return_counts=True)
        return values >> 32, values & 0xFFFFFFFF, [], n
    values, number, n = np.unique(joined, return_inverse=True, return_counts=True)
    del joined
    out = []
    for (length, place), part in zip(places, np.split(number, np.cumsum(sizes)[:-1])):
        row = np.zeros(length, np.int32)
        row[place] = part + 1
        out.append(row)
    return values >> 32, values & 0xFFFFFFFF, out, n


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Without zeros that follow a zero."""
    return codes[(codes > 0) | np.concatenate(([0], codes[:-1])).astype(bool)]


def extended(occurrences: DataFrame, steps: list[DataFrame], keep_positions: bool) -> DataFrame:
    """The next length: rows ``place, left, right, n`` and, with ``keep_positions``, its relation as rows ``block, codes``.

    ``steps`` are the frequent groups (``place, id``) of the relation, and of the lengths after it that are only on the way.
    """
    names = ["block", "codes", "place", "left", "right", "n"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    wanted = reduce(DataFrame.union, [_by_block(kept, k) for k, kept in enumerate(steps)])
    n_steps = len(steps)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        codes = [x.values.to_numpy() for chunk in left.column("codes").chunks for x in chunk]
        kept = {k: (code.values.to_numpy(), ids.values.to_numpy())
                for k, code, ids in zip(right.column("step").to_pylist(), *(right.column(c) for c in ("code", "id")))}
        block, out = key[0].as_py(), []
        for k in range(n_steps if len(kept) == n_steps else 0):
            code, ids = kept[k]
            key_of = np.zeros(max([int(c.max(initial=0)) for c in codes] + [int(code.max(initial=0))]) + 1, np.int64)
            key_of[code] = ids
            # the distinct pairs of a block are sorted, so they have the same numbers whenever they are made
            a, b, codes, n = _next_lengths(codes, key_of, keep_positions or k < n_steps - 1)
        for at in range(0, len(n) if kept.keys() == set(range(n_steps)) else 0, 1 << 16):
            part = slice(at, at + (1 << 16))
            size = len(n[part])
            out.append(_table(size, names, kinds, {"place": pa.array(block * _CODES + np.arange(at + 1, at + 1 + size)), "left": pa.array(key_of[a[part]]),
                                                   "right": pa.array(key_of[b[part]]), "n": pa.array(n[part])}))
        for row in map(_squeezed, codes if keep_positions and out else []):
            if len(row):
                out.append(_table(1, names, kinds, {"block": pa.array([block]), "codes": pa.ListArray.from_arrays(
                    pa.array([0, len(row)], pa.int32()), pa.array(row))}))
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds))))

    return (occurrences.groupBy("block").cogroup(wanted.groupBy("block"))
            .applyInArrow(run, "block long, codes array<int>, place long, left long, right long, n long"))


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, text_column: str = "text", lang_column: str = "lang",
                     block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` (words), and for each length ``id, left, right, a`` of its frequent phrases (``id, lang, word, a`` of words)."""
    small_batches(docs.sparkSession)
    texts = stored(word_occurrences(docs, text_column, lang_column, block_words), "word-occurrences")
    positions = texts.filter(F.col("codes").isNotNull()).select("block", "codes")
    words = texts.filter(F.col("word").isNotNull()).select("place", "lang", "word", "n")
    counts = words.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = stored(frequent(words, ["lang", "word"], min_count), "frequent-1")
    found, steps = [kept.filter("first").select("id", "lang", "word", "a")], [kept]
    for length in range(2, max_words + 1):
        stays = 2 < length < max_words  # of two words the texts' relation is read again: shorter than all pairs
        keys = extended(positions, steps, stays)
        if stays:
            keys = stored(keys, f"occurrences-{length}")
            positions = keys.filter(F.col("codes").isNotNull()).select("block", "codes")
        kept = stored(frequent(keys.filter(F.col("n").isNotNull()).select("place", "left", "right", "n"), ["left", "right"], min_count), f"frequent-{length}")
        steps = [*steps, kept] if length == 2 else [kept]
        found.append(kept.filter("first").select("id", "left", "right", "a"))
    return counts, found


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """``floor(2000000 * a / (left + right))``, exact for all 64-bit counts."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(left) + wide(right))


def mostly_inside(longer: Column, a: Column) -> Column:
    """Whether a phrase of ``a`` occurrences stands in a longer one in 80 of 100 of them."""
    return longer.isNotNull() & (longer.cast("decimal(19,0)") * 100 >= a.cast("decimal(19,0)") * 80)


def collocations(docs: DataFrame, top: int = TOP, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, text_column: str = "text",
                 lang_column: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language."""
    counts, found = frequent_phrases(docs, max_words, min_count, text_column, lang_column, block_words)
    one = F.array("a")
    known = found[0].select("id", "lang", F.array("word").alias("words"), one.alias("begin"), one.alias("end"))
    best = []
    for length in range(2, max_words + 1):
        left, right = (known.select(*(F.col(c).alias(f"{c}_{side}") for c in known.columns)) for side in "ab")
        named = (found[length - 1].join(left, F.col("left") == F.col("id_a")).join(right, F.col("right") == F.col("id_b"))
                 .select("id", F.col("lang_a").alias("lang"), F.concat("words_a", F.slice("words_b", -1, 1)).alias("words"), "a",
                         F.concat("begin_a", one).alias("begin"), F.concat("end_b", one).alias("end")))
        named = stored(named, f"phrases-{length}")
        known = named.drop("a")
        cuts = [F.struct(cut_score(F.col("a"), F.col("begin")[k - 1], F.col("end")[length - k - 1]).alias("score"), F.lit(k).alias("k"),
                         F.col("begin")[k - 1].alias("l"), F.col("end")[length - k - 1].alias("r")) for k in range(1, length)]
        scored = named.select("id", "lang", "words", "a", F.array_min(F.array(*cuts)).alias("cut"))
        if length < max_words:
            # the most frequent longer phrase around one is longer by one word
            longer = (found[length].select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer")))
            scored = scored.join(longer, "id", "left").filter(~mostly_inside(F.col("longer"), F.col("a")))
        best.append(scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    every = reduce(DataFrame.union, best).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return every.join(counts, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS s, count(*) AS a
  FROM w CROSS JOIN unnest([1, 2, 3, 4]) AS u(k) CROSS JOIN unnest(range(1, len(w) - k + 2)) AS v(i)
  GROUP BY ALL HAVING count(*) >= 30
), parts AS (
  SELECT lang, k, s, a, x, string_split(s, ' ') AS p FROM f CROSS JOIN unnest([1, 2, 3]) AS u(x) WHERE x < k
), heads AS (SELECT *, array_to_string(p[1:x], ' ') AS h, array_to_string(p[x + 1:], ' ') AS t FROM parts),
spans AS (
  SELECT lang, array_to_string(p[i:i + x - 1], ' ') AS s, max(a) AS longer FROM parts CROSS JOIN unnest([1, 2, 3]) AS v(i)
  WHERE i + x - 1 <= k GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.s, c.a, c.x AS cut, l.a AS l, r.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
  FROM heads c JOIN f l ON l.lang = c.lang AND l.s = c.h JOIN f r ON r.lang = c.lang AND r.s = c.t
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, s ORDER BY score, cut) AS place FROM cuts),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.s) AS rank
  FROM best LEFT JOIN spans ON spans.lang = best.lang AND spans.s = best.s
  WHERE place = 1 AND (longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
)
SELECT ranked.lang, rank, s AS phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
