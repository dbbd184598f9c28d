"""Phonetic codes for blocking."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.text import steps_sql

# The rules of English Metaphone (Philips, 1990), in order.  Source
# letters are lower case and codes upper case, so a coded sound is not read twice.
METAPHONE_RULES: tuple[tuple[str, str], ...] = (
    ("^[kgp]n", "n"), ("^ae", "e"), ("^wr", "r"), ("^x", "s"), ("^wh", "w"),
    ("mb$", "m"),
    ("sch", "sK"), ("tch", "X"), ("cia", "Xia"), ("ch", "X"), ("sc([iey])", "S$1"),
    ("c([iey])", "S$1"), ("ck", "K"), ("c", "K"),
    ("dg([iey])", "J$1"), ("d", "T"),
    ("gh([^aeiou])", "$1"), ("gn$", "n"), ("gneT$", "neT"), ("gh", "K"), ("g([iey])", "J$1"), ("g", "K"),
    ("ph", "F"), ("sh", "X"), ("th", "0"),
    ("si([oa])", "Xi$1"), ("ti([oa])", "Xi$1"),
    ("([aeiou])h([^aeiou]|$)", "$1$2"), ("h", "H"),
    ("w([aeiou])", "W$1"), ("w", ""), ("y([aeiou])", "Y$1"), ("y", ""),
    ("[qk]", "K"), ("v", "F"), ("x", "KS"), ("[sz]", "S"), ("t", "T"),
)


def metaphone_items(words: str) -> str:
    """Metaphone code of each lower-case ASCII word, as a chain of JVM-side replacements (SQL text)."""
    steps = [("regexp_replace", "[^a-z]", ""), ("regexp_replace", r"([abd-z])\1+", "$1"),
             *(("regexp_replace", pattern, code) for pattern, code in METAPHONE_RULES)]
    # a vowel is coded only where it opens the word
    coded = f"transform({words}, w -> {steps_sql('w', steps)})"
    return f"transform({coded}, c -> upper(concat(left(c, 1), regexp_replace(substring(c, 2), '[aeiou]', ''))))"


# The rules of Double Metaphone (Philips, 2000).  At each position the
# first rule that matches gives (primary code, alternate code); the matched text is
# consumed and look-around is context.  A leading "+" limits a rule to Slavic or
# Germanic looking words, a leading "-" to all others.
DOUBLE_METAPHONE_RULES: tuple[tuple[str, str, str], ...] = (
    ("^(?=GN|KN|PN|WR|PS).", "", ""),
    ("^X", "S", "S"),
    ("^[AEIOUY]", "A", "A"), ("[AEIOUY]", "", ""),
    ("BB?", "P", "P"),
    ("(?<=[^AEIOUY]A)CH(?![IE])|(?<=[BM]A)CH(?=ER)|CH(?=IA)", "K", "K"),
    ("^C(?=AESAR)A", "S", "S"),
    ("(?<!^)CH(?=AE)", "K", "X"),
    ("^CH(?!ORE)(?=ARAC|ARIS|OR|YM|IA|EM)", "K", "K"),
    ("(?<=^S)CH|(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)|CH(?=[TS])", "K", "K"),
    ("(?:(?<=[AOUE])|^)CH(?=[LRNMBHFVW]|$)", "K", "K"),
    ("(?<=^M)CH", "K", "K"), ("^CH", "X", "X"), ("CH", "X", "K"),
    ("(?<!WI)CZ", "S", "X"), ("CCIA", "X", "X"),
    ("(?<=^A)CC(?!HU)[IEH]|(?<=U)CC(?=EE|ES).", "KS", "KS"),
    ("(?<!^M)CC(?!HU)[IEH]", "X", "X"), ("(?<!^M)CC", "K", "K"),
    ("C[KGQ]", "K", "K"), ("CI(?=[OEA])", "S", "X"), ("C[IEY]", "S", "S"),
    ("CC(?![EI])|C", "K", "K"),
    ("DG[IEY]", "J", "J"), ("DG", "TK", "TK"), ("D[TD]?", "T", "T"),
    ("FF?", "F", "F"),
    ("(?<=[^AEIOUY])GH", "K", "K"), ("^GH(?=I)", "J", "J"), ("^GH", "K", "K"),
    ("(?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH", "", ""),
    ("(?<=[CGLRT].U)GH", "F", "F"), ("(?<=I)GH", "", ""), ("GH", "K", "K"),
    ("-(?<=^[AEIOUY])GN", "KN", "N"), ("-GN(?!EY)", "N", "KN"), ("GN", "KN", "KN"),
    ("-GL(?=I)", "KL", "L"),
    ("^G(?:Y|E(?=[SPBLYIR])|I(?=[BLNE]))", "K", "J"),
    ("(?<!^DAN)(?<!^RAN)(?<!^MAN)(?<![EI])G(?:E(?=R)|(?<![RO]G)Y)", "K", "J"),
    ("(?<=^SCH)G[EIY]|GE(?=T)", "K", "K"), ("GI(?=ER)", "J", "J"),
    ("G[EIY]|(?<=[AO]G)G(?=I)|(?<=[AO])GG(?=I)", "J", "K"), ("GG?", "K", "K"),
    ("(?:^|(?<=[AEIOUY]))H[AEIOUY]", "H", "H"), ("H", "", ""),
    ("^J(?=OSE$)", "H", "H"), ("J(?=OSE)", "J", "H"), ("^J", "J", "A"),
    ("-(?<=[AEIOUY])J(?=[AO])", "J", "H"), ("J$", "J", ""),
    ("(?<![SKL])J(?![LTKSNMBZ])J?", "J", "J"), ("JJ?", "", ""),
    ("KK?", "K", "K"),
    ("(?<=I)LL(?=[OA]$)|(?<=A)LL(?=E$)|(?<=A)LL(?=E.*(?:[AO]S|[AO])$)", "L", ""), ("LL?", "L", "L"),
    ("(?<=U)MB(?=$|ER)", "M", "M"), ("MM?", "M", "M"),
    ("NN?", "N", "N"),
    ("PH", "F", "F"), ("P[PB]?", "P", "P"),
    ("QQ?", "K", "K"),
    ("-(?<!ME)(?<!MA)(?<=IE)R$", "", "R"), ("RR?", "R", "R"),
    ("(?<=[IY])S(?=L)", "", ""), ("^S(?=UGAR)", "X", "S"),
    ("SH(?=EIM|OEK|OLM|OLZ)", "S", "S"), ("SH", "X", "X"),
    ("+SI[OA]", "S", "S"), ("SI[OA]", "S", "X"), ("^S(?=[MNLW])|SZ", "S", "X"),
    ("SCH(?=ER|EN)", "X", "SK"), ("SCH(?=OO|UY|ED|EM)", "SK", "SK"),
    ("^SCH(?![AEIOUYW])", "X", "S"), ("SCH", "X", "X"), ("SC[IEY]", "S", "S"), ("SC.?", "SK", "SK"),
    ("(?<=[AO]I)S$", "", "S"), ("S[SZ]?", "S", "S"),
    ("TIO(?=N)|TIA|TCH", "X", "X"), ("TH(?=[OA]M)|(?<=^SCH)TH", "T", "T"),
    ("TH|TT(?=H)", "0", "T"), ("T[TD]?", "T", "T"),
    ("VV?", "F", "F"),
    ("WR", "R", "R"), ("^W(?=[AEIOUY])", "A", "F"), ("^W(?=H)", "A", "A"),
    ("(?<=[AEIOUY])W$|(?<=[EO])W(?=SK[IY])|(?<=^SCH)W", "", "F"), ("WI[CT]Z", "TS", "FX"), ("W", "", ""),
    ("(?<=[IE]AU)X$|(?<=[AO]U)X$", "", ""), ("X[CX]?", "KS", "KS"),
    ("ZH", "J", "J"), ("Z(?=Z[OIA])Z", "S", "TS"), ("+(?<=[^T])ZZ?", "S", "TS"), ("ZZ?", "S", "S"),
)
_CODE_LENGTH = 4
_COMPILED = tuple((r[0] if r[0] in "+-" else "", re.compile(r.lstrip("+-")), p, a)
                  for r, p, a in DOUBLE_METAPHONE_RULES)
_SLAVO_GERMANIC = re.compile("W|K|CZ|WITZ")


def double_metaphone_codes(word: str) -> tuple[str, str]:
    """Primary and alternate code, at most four letters each."""
    word = re.sub("[^A-Z]", "", word.upper())
    mark = "+" if _SLAVO_GERMANIC.search(word) else "-"
    primary = alternate = ""
    pos = 0
    while pos < len(word) and min(len(primary), len(alternate)) < _CODE_LENGTH:
        for flag, pattern, first, second in _COMPILED:
            hit = pattern.match(word, pos) if flag in ("", mark) else None
            if hit:
                primary, alternate, pos = primary + first, alternate + second, hit.end()
                break
    return primary[:_CODE_LENGTH], alternate[:_CODE_LENGTH]


@F.pandas_udf(T.ArrayType(T.StringType()))
def double_metaphone_list(words: pd.Series) -> pd.Series:
    """Both codes of every word; each distinct word of the batch is coded once."""
    codes = {w: double_metaphone_codes(w) for w in {w for ws in words if ws is not None for w in ws}}
    return words.map(lambda ws: [] if ws is None else [c for w in ws for c in codes[w]])
