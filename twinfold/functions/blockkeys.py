"""Blocking predicates K1-K35: each maps one value to ``array<string>`` of keys.

Two records are candidates when they share a key.  A predicate takes a SQL
expression (usually a column name) and gives a SQL expression; :func:`keys`
turns that into a Column.  ``t`` is cleaned text (``text.normalize_text``),
``s`` a cleaned string array, ``x`` a number.  A value without content has no
key.  ``sequence`` counts down below its start, so short values are excluded
before it is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions import phonetic

NONE = "cast(array() as array<string>)"
_MAX_DIGITS = 36  # longer digit runs are keys as they stand: no decimal holds their neighbours


def _present(key: str) -> str:
    """Array of the key unless it is NULL or blank."""
    return f"if(cast({key} as string) <> '', array(cast({key} as string)), {NONE})"


def _if(condition: str, result: str) -> str:
    return f"case when {condition} then {result} else {NONE} end"


def words(t: str) -> str:
    """Runs of letters and digits of any script, in order."""
    return f"array_remove(split(regexp_replace({t}, '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), '')"


def digit_runs(t: str) -> str:
    """Digit runs of any length without leading zeros, in order."""
    return f"transform(regexp_extract_all({t}, '([0-9]+)', 1), d -> regexp_replace(d, '^0+(?=.)', ''))"


def _near(t: str, *keys: str) -> str:
    """Keys computed from each digit run ``n``."""
    n = "cast(d as decimal(38,0))"
    made = ", ".join(f"cast({k.format(n=n)} as string)" for k in keys)
    return f"array_distinct(flatten(transform({digit_runs(t)}, d -> if(length(d) <= {_MAX_DIGITS}, array({made}), array(d)))))"


def as_set(s: str) -> str:
    """Sorted distinct non-blank items (``sort_array`` has a native comparator)."""
    return f"sort_array(array_distinct(filter({s}, i -> i <> '')))"


def _char_grams(x: str, n: int) -> str:
    grams = f"transform(sequence(1, length({x}) - {n - 1}), i -> substring({x}, i, {n}))"
    return _if(f"length({x}) >= {n}", f"array_distinct({grams})")


def _word_grams(w: str, n: int) -> str:
    grams = f"transform(sequence(1, size({w}) - {n - 1}), i -> concat_ws(' ', slice({w}, i, {n})))"
    return _if(f"size({w}) >= {n}", f"array_distinct({grams})")


def _no_blanks(t: str) -> str:
    return f"replace({t}, ' ', '')"


def whole_field(t):  # K1
    return _present(t)


def token_field(t):  # K2
    return f"array_distinct({words(t)})"


def first_token(t):  # K3
    return f"slice({words(t)}, 1, 1)"


def first_two_tokens(t):  # K4
    return _if(f"size({words(t)}) >= 2", f"array(concat_ws(' ', slice({words(t)}, 1, 2)))")


def common_integer(t):  # K5
    return f"array_distinct({digit_runs(t)})"


def alpha_numeric(t):  # K6
    return f"array_distinct(filter({words(t)}, w -> w rlike '[0-9]'))"


def near_integers(t):  # K7
    return _near(t, "({n} - 1)", "{n}", "({n} + 1)")


def hundred_integer(t):  # K8
    return _near(t, "({n} + 50 - ({n} + 50) % 100)")


def hundred_integers_odd(t):  # K9
    return _near(t, "({n} + 50 - ({n} + 50) % 100 + {n} % 2)")


def first_integer(t):  # K10
    return f"slice({digit_runs(t)}, 1, 1)"


def ngram_tokens(t, n: int = 2):  # K11
    return _word_grams(words(t), n)


def common_two_tokens(t):  # K12
    return ngram_tokens(t, 2)


def common_three_tokens(t):  # K13
    return ngram_tokens(t, 3)


def fingerprint(t):  # K14
    return _present(f"concat_ws(' ', sort_array({words(t)}))")


def one_gram_fingerprint(t):  # K15
    return _present(f"array_join(sort_array({_char_grams(_no_blanks(t), 1)}), '')")


def two_gram_fingerprint(t):  # K16
    return _present(f"array_join(sort_array({_char_grams(_no_blanks(t), 2)}), '')")


def common_four_gram(t):  # K17
    return _char_grams(t, 4)


def common_six_gram(t):  # K18
    return _char_grams(t, 6)


def same_three_char_start(t):  # K19
    return _present(f"left({t}, 3)")


def same_five_char_start(t):  # K20
    return _present(f"left({t}, 5)")


def same_seven_char_start(t):  # K21
    return _present(f"left({t}, 7)")


def suffix_array(t):  # K22
    x = _no_blanks(t)
    return _if(f"length({x}) >= 4", f"transform(sequence(1, length({x}) - 3), i -> substring({x}, i))")


def sorted_acronym(t):  # K23
    return _present(f"array_join(sort_array(transform({words(t)}, w -> left(w, 1))), '')")


def metaphone_token(t):  # K24
    return f"array_distinct(filter({phonetic.metaphone_items(words(t))}, c -> c <> ''))"


def double_metaphone(t):  # K25, over the column made by with_phonetic
    return f"array_distinct(filter({phonetic_column(t)}, c -> c <> ''))"


def whole_set(s):  # K26
    return _present(f"array_join({as_set(s)}, ' ')")


def common_set_element(s):  # K27
    return as_set(s)


def common_two_elements(s):  # K28
    u = as_set(s)
    return f"flatten(transform({u}, (a, i) -> transform(slice({u}, i + 2, size({u})), b -> concat_ws(' ', a, b))))"


def common_three_elements(s):  # K29
    u = as_set(s)
    return (f"flatten(flatten(transform({u}, (a, i) -> transform(slice({u}, i + 2, size({u})), "
            f"(b, j) -> transform(slice({u}, i + j + 3, size({u})), c -> concat_ws(' ', a, b, c))))))")


def last_set_element(s):  # K30
    return _present(f"array_max({as_set(s)})")


def first_set_element(s):  # K31
    return _present(f"array_min({as_set(s)})")


def magnitude_of_cardinality(s):  # K32
    n = f"size({as_set(s)})"
    return _if(f"{n} > 0", _present(f"cast(round(log10({n})) as int)"))


def lat_long_grid(lat: str, lon: str) -> str:  # K33
    cell = ", ".join(f"cast(round(cast({x} as decimal(12,6)), 1) as string)" for x in (lat, lon))
    return _if(f"{lat} <> 0 or {lon} <> 0", _present(f"concat_ws('_', {cell})"))


def order_of_magnitude(x):  # K34
    return _if(f"{x} > 0", _present(f"cast(round(log10({x})) as int)"))


def round_to_1(x):  # K35
    scale = f"pow(10.0D, floor(log10(abs({x}))))"
    return _if(f"{x} <> 0", _present(f"cast(round({x} / {scale}) * {scale} as decimal(30,6))"))


def near_column(field: str) -> str:
    return f"__near_keys_{field}"


def near(field):
    """Near agreement: the keys that ``nearness.with_near_keys`` adds for a column."""
    return near_column(field)


# name -> predicate over one value; K33 takes two and is called directly
PREDICATES: dict[str, Callable[[str], str]] = {
    f.__name__: f
    for f in (
        whole_field, token_field, first_token, first_two_tokens, common_integer, alpha_numeric,
        near_integers, hundred_integer, hundred_integers_odd, first_integer, ngram_tokens,
        common_two_tokens, common_three_tokens, fingerprint, one_gram_fingerprint,
        two_gram_fingerprint, common_four_gram, common_six_gram, same_three_char_start,
        same_five_char_start, same_seven_char_start, suffix_array, sorted_acronym,
        metaphone_token, double_metaphone, whole_set, common_set_element, common_two_elements,
        common_three_elements, last_set_element, first_set_element, magnitude_of_cardinality,
        order_of_magnitude, round_to_1, near,
    )
}


def keys(predicate: str, value: str) -> Column:
    """The keys of a value (a column name or SQL expression) under a named predicate."""
    return F.expr(PREDICATES[predicate](value))


def phonetic_column(field: str) -> str:
    return f"__phonetic_{field}"


def with_phonetic(df: DataFrame, fields: list[str]) -> DataFrame:
    """The codes that ``double_metaphone`` reads, for the given text columns."""
    return df.withColumns({phonetic_column(f): phonetic.double_metaphone_list(F.expr(words(f))) for f in fields}) \
        if fields else df
