"""Text, list, date and casting expressions.

Everything here builds a Catalyst expression; no row is handed to Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns deleted, in this order, by text normalisation.
JUNK_PATTERNS = (
    r"\bnone\b",
    r"\[\]",
    r"\[''\]",
    "T00 00 00.000Z",
    "T00:00:00.000Z",
    "00 00 00.000",
    "00:00:00.000",
)
# Separator between the items of a list stored as text.
LIST_SEPARATOR = "@@@"
# Literals that count as missing when profiling (case-sensitive).
MISSING_TOKENS = ("", "nan", "NaN", "None", "none")

# Transliterations that are not a base letter plus an accent.
ONE_TO_ONE = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "×": "x", "÷": "/",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", " ": " ",
}
ONE_TO_MANY = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "ŋ": "ng", "€": "EUR", "°": "deg", "…": "...", "—": "--", "«": "<<", "»": ">>",
}

# The usual Latin forms of Greek and Cyrillic letters.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя",
                    "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia".split()))

# Latin, Greek and Cyrillic letters, and full-width forms
_BLOCKS = ((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000), (0xFB00, 0xFB07), (0xFF10, 0xFF5B))
_COMBINING = "".join(chr(c) for c in range(0x0300, 0x0370))
_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

Step = tuple[str, ...]  # name of a SQL function and its literal arguments after the first


def _decompose(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


def _latin(letter: str) -> str:
    for table in (GREEK, CYRILLIC):
        if letter.lower() in table:
            out = table[letter.lower()]
            return out if letter.islower() else out.capitalize()
    return ONE_TO_ONE.get(letter, ONE_TO_MANY.get(letter, letter))


def _letter_tables(fold: Callable[[str], str]) -> tuple[dict[str, str], dict[str, str]]:
    """The letters and digits of the blocks that ``fold`` changes, by length of the result."""
    single, multi = {}, {}
    for lo, hi in _BLOCKS:
        for ch in map(chr, range(lo, hi)):
            base = fold(ch)
            if ch.isalnum() and base and base != ch:
                (single if len(base) == 1 else multi)[ch] = base
    return single, multi


_ACCENTS, _LIGATURES = _letter_tables(_decompose)
_LETTERS, _LETTER_GROUPS = _letter_tables(lambda ch: "".join(map(_latin, _decompose(ch))))


def _fold_steps(single: dict[str, str], multi: dict[str, str]) -> list[Step]:
    return [("translate", "".join(single) + _COMBINING, "".join(single.values()))] + [
        ("replace", src, dst) for src, dst in multi.items()]


# runs of whitespace other than one plain space, which is most of them
_SQUEEZE: list[Step] = [
    ("regexp_replace", r"[\t\n\x0B\f\r\x1c-\x1f][\s\x1c-\x1f]*| [\s\x1c-\x1f]+", " "), ("trim",)]
_REMOVE_ACCENTS = _fold_steps(_ACCENTS, _LIGATURES)
_NORMALIZE: list[Step] = [
    *_fold_steps(_LETTERS | ONE_TO_ONE, _LETTER_GROUPS | ONE_TO_MANY),
    *(("regexp_replace", "(?i)" + pattern, "") for pattern in JUNK_PATTERNS),
    ("regexp_replace", r"[,/\n:]+", " "),
    ("replace", "+33", "0"),
    ("btrim", _SPACES), ("btrim", '"'), ("btrim", "'"),
    ("lower",),
    *_SQUEEZE,
]
# Any trace of what the steps above act on.  A value without one, as most short
# fields are, only has to be trimmed and lowered.
_UNUSUAL = r"""(?i)[^\x20-\x7E]|[,/:"'\[]|\+33|  |\bnone\b|""" + "|".join(JUNK_PATTERNS[3:])
_PLAIN: list[Step] = [("trim",), ("lower",)]


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def steps_sql(x: str, steps: Sequence[Step]) -> str:
    """The steps applied to a SQL expression, as SQL text: parsed at once, whatever its length."""
    for fn, *args in steps:
        x = f"{fn}({', '.join([x, *map(_quoted, args)])})"
    return x


def apply_steps(c: Column | str, steps: Sequence[Step]) -> Column:
    """The steps applied to a column, or to a SQL expression such as a column name."""
    if isinstance(c, str):
        return F.expr(steps_sql(c, steps))
    for fn, *args in steps:
        c = F.call_function(fn, c, *map(F.lit, args))
    return c


def map_items(c: Column, body: str) -> Column:
    """``transform(c, x -> body)`` with the body as SQL text."""
    return F.call_function("transform", c, F.expr(f"x -> {body}"))


def keep_items(c: Column, condition: str) -> Column:
    """``filter(c, x -> condition)`` with the condition as SQL text."""
    return F.call_function("filter", c, F.expr(f"x -> {condition}"))


def remove_accents(c: Column | str) -> Column:
    """Drop diacritics; letters without a decomposition (œ, ß, ø) stay."""
    return apply_steps(c, _REMOVE_ACCENTS)


def normalize_sql(x: str) -> str:
    """C1 of a SQL expression, as SQL text."""
    x = f"coalesce({x}, '')"
    return f"if({x} rlike {_quoted(_UNUSUAL)}, {steps_sql(x, _NORMALIZE)}, {steps_sql(x, _PLAIN)})"


def normalize_text(c: Column | str) -> Column:
    """Canonical lower-case ASCII form of a value; NULL becomes ''."""
    if isinstance(c, str):
        return F.expr(normalize_sql(f"cast({c} as string)"))
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike(_UNUSUAL), apply_steps(c, _NORMALIZE)).otherwise(apply_steps(c, _PLAIN))


def normalize_items(c: Column) -> Column:
    """C1 on every item of a list."""
    return map_items(c, normalize_sql("x"))


def clean_cell(c: Column | str) -> Column:
    """C2 for a scalar: C1, with a left-over ``none`` blanked."""
    t = normalize_text(c)
    return F.when(t == "none", "").otherwise(t)


def clean_list(c: Column) -> Column:
    """C2 for a list: C1 on each item, blanks and ``none`` dropped, [] if none is left."""
    return keep_items(normalize_items(F.coalesce(c, _no_strings())), "x not in ('', 'none')")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def parse_nested_list(c: Column, is_array: bool = False, separator: str = LIST_SEPARATOR) -> Column:
    """A separated text (or a ready array) to a stable list of distinct items."""
    if not is_array:
        c = F.split(c.cast("string"), "\\Q" + separator + "\\E")
    return F.array_distinct(clean_list(c))


def enrich_emails(c: Column) -> Column:
    """C4: each address followed by its local part, distinct in first-seen order."""
    usable = keep_items(clean_list(c), "contains(x, '@') and trim(substring_index(x, '@', 1)) <> ''")
    return F.array_distinct(F.flatten(map_items(usable, "array(x, trim(substring_index(x, '@', 1)))")))


def normalize_birth_date(c: Column | str) -> Column:
    """C1, then the text before the first space."""
    return F.substring_index(normalize_text(c), " ", 1)


def unique_non_empty(*values: Column) -> Column:
    """Distinct C1 forms of the items of several lists, blanks dropped."""
    return F.array_distinct(keep_items(normalize_items(F.concat(*values)), "x <> ''"))


def product_join(*lists: Column) -> Column:
    """All combinations of one item per list, blanks skipped, joined by spaces.

    The result grows with the product of the list lengths, as it must: the
    lists are the spellings of one record and are kept whole.
    """
    def extend(done: Column, following: Column) -> Column:
        return F.flatten(F.transform(done, lambda x: F.transform(
            following, lambda y: F.trim(F.concat_ws(" ", x, y)))))

    out = reduce(extend, lists)
    return F.array_distinct(keep_items(out, "x <> ''"))


def full_name_candidates(family: Sequence[Column], first: Sequence[Column]) -> Column:
    """Every 'family first' spelling; empty when either side has no value."""
    return product_join(unique_non_empty(*family), unique_non_empty(*first))


def address_candidates(street: Column, complement: Column, city: Column, postal: Column) -> Column:
    """Every street × complement × city × postal code combination."""
    def or_blank(c: Column) -> Column:
        # a list without values takes part as one blank
        return F.call_function("ifnull", F.nullif(unique_non_empty(c), _no_strings()), F.array(F.lit("")))

    return product_join(*(or_blank(c) for c in (street, complement, city, postal)))


def safe_int(c: Column, default: int | None = None) -> Column:
    """Integer or default.  Text must be a plain signed integer; numbers truncate."""
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(c: Column, default: float | None = None) -> Column:
    """Double or default."""
    return F.coalesce(c.try_cast("double"), F.lit(default).cast("double"))


def safe_str(c: Column, default: str = "") -> Column:
    """C11: string or default."""
    return F.coalesce(c.cast("string"), F.lit(default))


def normalize_no_accents(c: Column) -> Column:
    """Trim, lower, drop accents, collapse spaces; NULL becomes ''."""
    return apply_steps(F.lower(F.coalesce(c, F.lit(""))), [*_REMOVE_ACCENTS, *_SQUEEZE])


def is_ascii(c: Column) -> Column:
    """C14: whether every character is ASCII."""
    return ~c.rlike(r"[^\x00-\x7F]")


def substrings_included(substrings: Sequence[str], c: Column) -> Column:
    """The listed substrings that occur in the text, in list order."""
    wanted = F.array(*(F.lit(s) for s in substrings if s)) if any(substrings) else _no_strings()
    return F.filter(wanted, lambda s: F.contains(F.coalesce(c, F.lit("")), s))


def chunk_list(c: Column, n: int) -> Column:
    """Consecutive slices of at most ``n`` items."""
    if n <= 0:
        raise ValueError("chunk size must be positive")
    starts = F.sequence(F.lit(1), F.size(c), F.lit(n))
    chunks = F.transform(starts, lambda i: F.slice(c, i, n))
    return F.when(F.size(c) > 0, chunks).otherwise(F.slice(F.array(c), 1, 0))


def random_string(length: int = 12, seed: int | None = None) -> Column:
    """C17: random alphanumeric text, a fresh one per row."""
    length = max(1, length)
    return F.randstr(F.lit(length), F.lit(seed)) if seed is not None else F.randstr(F.lit(length))


def parse_json_payload(c: Column, schema: str) -> Column:
    """UTF-8 bytes to a JSON struct; NULL where the content is not valid JSON."""
    text = c.try_cast("string")
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def age_in_years(birth_date: Column, as_of: Column) -> Column:
    """Days since birth over 365, rounded half to even."""
    days = F.datediff(as_of, F.try_to_date(birth_date, "yyyy-MM-dd"))
    return F.bround(days / F.lit(365.0), 0)


def missing_like(c: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """P10: NULL, or a literal that stands for a missing value."""
    return c.isNull() | F.coalesce(c.cast("string").isin(list(tokens)), F.lit(False))
