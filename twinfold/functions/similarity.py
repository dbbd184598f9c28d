"""Pair similarities G1-G10.

Comparisons that Catalyst has stay in Catalyst.  Affine gap and the item ratio
run as Arrow-batched dynamic programs: each distinct pair of a batch is
computed once, and a whole row of the table is one vector step for many pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An item pair matches above this ratio (strictly).
LIST_SIMILARITY_THRESHOLD = 85
# Default affine gap costs.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 1.0, 11.0, 10.0, 7.0

_CELLS = 1_000_000  # table cells held per vector step


def exact(left: str, right: str) -> str:
    """G1: 1 when equal, else 0."""
    return f"cast({left} = {right} as double)"


def overlap(left: str, right: str) -> str:
    """1 when two lists share an item, else 0."""
    return f"cast(coalesce(arrays_overlap({left}, {right}), false) as double)"


def date_distance(left: str, right: str) -> str:
    """Square root of the days between two YYYY-MM-DD texts; NULL if either is no date."""
    return f"sqrt(abs(datediff(try_to_date({left}, 'yyyy-MM-dd'), try_to_date({right}, 'yyyy-MM-dd'))))"


def edit_similarity(left: str, right: str) -> str:
    """1 - levenshtein / longer length; two empty texts are alike."""
    longest = f"greatest(length({left}), length({right}))"
    return f"if({longest} = 0, 1.0D, 1.0D - levenshtein({left}, {right}) / {longest})"


# comparisons that stay in the JVM, as SQL text over two expressions
NATIVE: dict[str, Callable[[str, str], str]] = {
    "Exact": exact, "Overlap": overlap, "DateTime": date_distance, "Edit": edit_similarity,
}


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded code points, one row per text, and the lengths."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, sizes.max(initial=0))), dtype=np.uint32)
    for row, t in enumerate(texts):
        out[row, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, sizes


def _affine_gap_block(left: list[str], right: list[str], costs: tuple[float, float, float, float]) -> np.ndarray:
    match, mismatch, gap_open, extend = costs
    (a, na), (b, nb) = _codes(left), _codes(right)
    cols = np.arange(b.shape[1] + 1) * extend
    best = np.tile(np.where(cols > 0, gap_open + cols, 0.0), (len(left), 1))
    down = np.full_like(best, np.inf)
    result = best[np.arange(len(left)), nb]
    for i in range(1, a.shape[1] + 1):
        down = np.minimum(best + gap_open, down) + extend
        step = np.where(a[:, i - 1 : i] == b, match, mismatch)
        row = down.copy()
        row[:, 1:] = np.minimum(row[:, 1:], best[:, :-1] + step)
        # cheapest gap along the row: a running minimum of (cell - distance)
        across = np.minimum.accumulate(row - cols, axis=1) + cols + gap_open
        row[:, 1:] = np.minimum(row[:, 1:], across[:, :-1] + extend)
        best = row
        done = na == i
        result[done] = best[done, nb[done]]
    return result / np.maximum(na + nb, 1)


def _letters(*tables: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The tables with their code points numbered from 0, and how many there are."""
    seen = np.zeros(max(int(t.max(initial=0)) for t in tables) + 1, dtype=bool)
    for t in tables:
        seen[t] = True
    number = np.cumsum(seen) - 1
    return [number[t] for t in tables], int(number[-1]) + 1


def _letter_masks(codes: np.ndarray, sizes: np.ndarray, letters: int) -> np.ndarray:
    """``[text, letter, word]``: a bit for each place of the letter in the text; the letter after the last one has no place."""
    masks = np.zeros((len(codes), letters + 1, -(-codes.shape[1] // 64)), dtype=np.uint64)
    for k in range(codes.shape[1]):
        rows = np.flatnonzero(sizes > k)
        masks[rows, codes[rows, k], k // 64] |= np.uint64(1 << k % 64)
    return masks


def _common_lengths(codes: np.ndarray, masks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common subsequences of texts ``left`` of ``codes`` with texts ``right`` of ``masks``.

    One row of the table is a bit vector: a bit is cleared where the length grows (Hyyrö's method).
    """
    row, flat = right * masks.shape[1], masks.reshape(-1, masks.shape[2])
    free = [np.full(len(left), ~np.uint64(0)) for _ in range(masks.shape[2])]
    for k in range(codes.shape[1]):
        at, carry = row + codes[left, k], None
        for w, x in enumerate(free):
            hit = x & flat[at, w]
            total = x + hit
            if len(free) > 1:
                over = total < x
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            free[w] = total | (x ^ hit)
    return sum(np.bitwise_count(~x).astype(np.int64) for x in free)


def _common_length_block(left: list[str], right: list[str]) -> np.ndarray:
    (a, na), (b, nb) = _codes(left), _codes(right)
    (a, b), letters = _letters(a, b)
    a[np.arange(a.shape[1]) >= na[:, None]] = letters  # no place
    rows = max(1, _CELLS // ((letters + 1) * -(-b.shape[1] // 64)))
    result = np.zeros(len(left), dtype=np.int64)
    for k in range(0, len(left), rows):
        masks = _letter_masks(b[k : k + rows], nb[k : k + rows], letters)
        each = np.arange(len(masks))
        result[k : k + rows] = _common_lengths(a[k : k + rows], masks, each, each)
    return result


def _bags(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``[word, text]``: how often the letters of 32 kinds are in a text, a bit for each of the first four.

    Bits that differ between two texts are at most the letters outside of a common subsequence.
    """
    bags, counts = np.zeros((2, len(codes)), dtype=np.uint64), np.zeros((len(codes), 32), dtype=np.int64)
    for k in range(codes.shape[1]):
        rows = np.flatnonzero(sizes > k)
        kind = (codes[rows, k] & 31).astype(np.int64)
        n = counts[rows, kind]
        counts[rows, kind] += 1
        rows, kind, n = (x[n < 4] for x in (rows, kind, n))
        bags[kind // 16, rows] |= np.uint64(1) << (kind % 16 * 4 + n).astype(np.uint64)
    return bags


def close_items(left: list[str], right: list[str], same: bool, longer_than: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs with a ratio above the list threshold, each once, in pieces; ``same``: both lists are one.

    Pairs of two texts of at most ``longer_than`` letters are left out.  A pair is compared if the letters
    of its texts, without their order, leave that ratio possible.
    """
    if not left or not right:
        return
    by_size = [np.array(sorted(range(len(x)), key=lambda k: len(x[k]))) for x in (left, right)]
    (a, na), (b, nb) = (_codes([x[k] for k in order]) for x, order in zip((left, right), by_size))
    bag_a, bag_b = _bags(a, na), _bags(b, nb)
    (a, b), letters = _letters(a, b)
    a[np.arange(a.shape[1]) >= na[:, None]] = letters  # no place
    runs = [(n, *np.searchsorted(na, [n, n + 1])) for n in np.unique(na)]
    words = -(-b.shape[1] // 64)
    rows = max(1, min(_CELLS // 2 // len(left), _CELLS // ((letters + 1) * words)))
    for low in range(0, len(right), rows):
        high, found = min(low + rows, len(right)), []
        for m in np.unique(nb[low:high]):
            first, last = low + np.searchsorted(nb[low:high], [m, m + 1])
            for n, start, stop in runs:
                total = int(n + m)
                most = ((100 - LIST_SIMILARITY_THRESHOLD) * total - 1) // 100  # letters that a pair may leave out
                if abs(int(n - m)) > most or max(n, m) <= longer_than or same and start >= last:
                    continue
                apart = np.bitwise_count(bag_a[0, start:stop, None] ^ bag_b[0, None, first:last])
                i, j = np.divmod(np.flatnonzero(apart <= most), last - first)
                apart, i, j = apart[i, j], i + start, j + first
                kept = apart + np.bitwise_count(bag_a[1, i] ^ bag_b[1, j]) <= most
                if same:
                    kept &= i < j
                found.append((i[kept], j[kept]))
        if found and sum(len(i) for i, _ in found):
            i, j = (np.concatenate(x) for x in zip(*found))
            masks = _letter_masks(b[low:high], nb[low:high], letters)
            for k in range(0, len(i), _CELLS // 16):
                x, y = i[k : k + _CELLS // 16], j[k : k + _CELLS // 16]
                near = 200 * _common_lengths(a, masks, x, y - low) > LIST_SIMILARITY_THRESHOLD * (na[x] + nb[y])
                if near.any():
                    yield by_size[0][x[near]], by_size[1][y[near]]


def _blocked(pairs: list[tuple[str, str]], block: Callable[[list[str], list[str]], np.ndarray]) -> np.ndarray:
    """Run a block function over pairs of similar length so that little is padded."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    out = np.zeros(len(pairs))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start) * (len(pairs[order[stop]][1]) + 1) < _CELLS:
            stop += 1
        rows = order[start:stop]
        out[rows] = block([pairs[k][0] for k in rows], [pairs[k][1] for k in rows])
        start = stop
    return out


def _per_distinct_pair(left: pd.Series, right: pd.Series, block) -> pd.Series:
    pairs = list(zip(left, right))
    distinct = list({p for p in pairs if p[0] is not None and p[1] is not None})
    value = dict(zip(distinct, _blocked(distinct, block)))
    return pd.Series([value.get(p) for p in pairs], dtype="float64")


def affine_gap(match: float = MATCH, mismatch: float = MISMATCH,
               gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND) -> Callable[[Column, Column], Column]:
    """Affine gap distance over the summed lengths, as a function of two text columns."""
    costs = (match, mismatch, gap_open, gap_extend)

    @F.pandas_udf(T.DoubleType())
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        return _per_distinct_pair(left, right, lambda x, y: _affine_gap_block(x, y, costs))

    return _once(distance)


def least_affine_gap(left: str, right: str) -> str:
    """SQL: a distance that G2 with its default costs is not below, from the edit distance.

    Beyond half a match a letter, an alignment of texts of one length pays for each replaced letter or for two gaps at least,
    and otherwise for one gap and its letters.
    """
    replaced, extended = MISMATCH - MATCH, GAP_EXTEND - MATCH / 2
    both, edits = f"(length({left}) + length({right}))", f"if({left} = {right}, 0, levenshtein({left}, {right}))"
    paid = (f"if(length({left}) = length({right}), {replaced}D * least({edits}, {2 * GAP_OPEN / (replaced - extended)}D), "
            f"{GAP_OPEN}D + {extended}D * levenshtein({left}, {right}))")
    return f"({MATCH / 2}D + {paid} / greatest({both}, 1))"


def _once(udf):
    """A function that no filter on its result is pushed below: it is computed once a row, outside of joins."""
    return udf.asNondeterministic()


@_once
@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """200 * longest common subsequence / summed lengths; two empty texts give 100."""
    return _per_distinct_pair(left, right, _ratio_block)


def _ratio_block(left: list[str], right: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(left, right)])
    return np.where(total == 0, 100.0, 200.0 * _common_length_block(left, right) / np.maximum(total, 1))


@_once
@F.pandas_udf(T.BooleanType())
def _any_close_pair(pairs: pd.Series) -> pd.Series:
    found = [[tuple(p) for p in ps] if ps is not None else [] for ps in pairs]
    distinct = list({p for ps in found for p in ps})
    close = {p for p, v in zip(distinct, _blocked(distinct, _ratio_block)) if v > LIST_SIMILARITY_THRESHOLD}
    return pd.Series([any(p in close for p in ps) for ps in found], dtype="bool")


def with_near_items(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Columns that :func:`lists_similar` reads: the item pairs that can still pass.

    A common subsequence leaves out at least as many letters as the edit
    distance counts, so a pair with a larger edit distance is settled here, in
    the JVM; so are lists that share an item.
    """
    most = f"cast(floor((length(x) + length(y)) * {100 - LIST_SIMILARITY_THRESHOLD} / 100) as int)"

    def near(field: str) -> str:
        close = f"filter(r.{field}, y -> levenshtein(x, y, {most}) >= 0)"
        items = f"flatten(transform(l.{field}, x -> transform({close}, y -> array(x, y))))"
        return f"if(arrays_overlap(l.{field}, r.{field}), null, {items})"

    return pairs.withColumns({f"__near_{f}": F.expr(near(f)) for f in dict.fromkeys(fields)}) if fields else pairs


def lists_similar(field: str) -> Column:
    """1 if some item pair of the lists ``l.field`` and ``r.field`` has a ratio above the threshold, else 0."""
    same = F.coalesce(F.arrays_overlap(f"l.{field}", f"r.{field}"), F.lit(False))
    near = F.col(f"__near_{field}")
    return (same | ((F.size(near) > 0) & _any_close_pair(near))).cast("double")
