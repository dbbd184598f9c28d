"""SQL building blocks of the oracles: the persons view and its cleaned form in DuckDB SQL.

Written independently of the Spark expressions: accents go through the
database's own ``strip_accents``, list functions through its lambdas.
"""

from __future__ import annotations

PERSONS = """
persons AS (
  WITH base AS (
    SELECT c.c_custkey AS k, c.c_mktsegment AS origin, c.c_nationkey AS nk, n.n_name AS city,
           split_part(p.p_name, ' ', 1) AS w1,
           concat(split_part(p.p_name, ' ', 2), translate(CAST(c.c_custkey AS VARCHAR), '0123456789', 'aeioulnrst')) AS w2
    FROM customer c
    JOIN part p ON p.p_partkey = c.c_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey
  ), copies AS (
    SELECT 0 AS cp, b.* FROM base b
    UNION ALL
    SELECT 1 AS cp, b.* FROM base b WHERE b.k % 4 = 0
    UNION ALL
    SELECT 2 AS cp, b.* FROM base b WHERE b.k % 12 = 0
  )
  SELECT k * 10 + cp AS id, k AS entity_id, origin,
    CASE WHEN k % 11 = 0 AND cp = 1 THEN '' WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    CASE WHEN cp = 1 THEN concat(' ', upper(translate(w2, 'e', 'é')), ' ')
         WHEN cp = 2 THEN concat(substr(w2, 1, 2), substr(w2, 4)) ELSE w2 END AS birth_family_name,
    CASE WHEN cp = 1 THEN concat(substr(w1, 1, 2), 'x', substr(w1, 3)) ELSE w1 END AS birth_first_name,
    CASE WHEN cp = 2 THEN ''
         WHEN cp = 1 THEN concat(CAST(DATE '1950-01-01' + CAST((k * 37) % 20000 AS INT) AS VARCHAR), 'T00:00:00.000Z')
         ELSE CAST(DATE '1950-01-01' + CAST((k * 37) % 20000 AS INT) AS VARCHAR) END AS birth_date,
    CASE WHEN cp = 2 THEN concat(w2, '@mail.org')
         WHEN cp = 1 THEN concat(w1, '.', w2, '@Example.com@@@', w2, '@mail.org')
         ELSE concat(w1, '.', w2, '@Example.com') END AS emails,
    CASE WHEN cp = 2 THEN '' ELSE concat('+33', lpad(CAST(k AS VARCHAR), 9, '6'),
         CASE WHEN k % 3 = 0 THEN '@@@none' ELSE '' END) END AS telephones,
    concat(CAST(k % 97 AS VARCHAR), ' rue ', w1) AS addresses_street,
    CASE WHEN k % 7 = 0 THEN '' ELSE city END AS addresses_city,
    lpad(CAST(nk * 1000 + k % 50 AS VARCHAR), 5, '0') AS addresses_postal_code
  FROM copies
)"""

_JUNK = (r"\bnone\b", r"\[\]", r"\[''\]", "T00 00 00.000Z", "T00:00:00.000Z", "00 00 00.000", "00:00:00.000")


def norm(x: str) -> str:
    """C1 as SQL."""
    s = f"coalesce(CAST({x} AS VARCHAR), '')"
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"strip_accents({s})"
    for pattern in _JUNK:
        doubled = pattern.replace("'", "''")
        s = f"regexp_replace({s}, '{doubled}', '', 'gi')"
    s = f"replace(regexp_replace({s}, '[,/\\n:]+', ' ', 'g'), '+33', '0')"
    s = f"""trim(trim(trim({s}, e' \\t\\n\\r'), '"'), '''')"""
    return f"trim(regexp_replace(lower({s}), '\\s+', ' ', 'g'))"


def distinct(items: str) -> str:
    """First occurrences, in order."""
    return f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"


def parsed(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '@@@'), lambda v: {norm('v')}), lambda v: v NOT IN ('', 'none'))"


LISTS = ("emails", "telephones", "addresses_street", "addresses_city", "addresses_postal_code")

CLEAN = f"""
parsed AS (
  SELECT id AS record_id, entity_id, {norm('origin')} AS origin, {norm('sex')} AS sex,
    {norm('birth_family_name')} AS birth_family_name, {norm('birth_first_name')} AS birth_first_name,
    split_part({norm('birth_date')}, ' ', 1) AS birth_date,
    {', '.join(f'{parsed(c)} AS {c}' for c in LISTS)}
  FROM persons
), unique_lists AS (
  SELECT * EXCLUDE ({', '.join(LISTS)}), {', '.join(f'{distinct(c)} AS {c}' for c in LISTS)} FROM parsed
), enriched AS (
  SELECT * REPLACE (flatten(list_transform(list_filter(emails, lambda v: contains(v, '@') AND v NOT LIKE '@%'),
                    lambda v: [v, split_part(v, '@', 1)])) AS emails) FROM unique_lists
), clean AS (
  SELECT * REPLACE ({distinct('emails')} AS emails) FROM enriched
)"""


def over_persons(sql: str, *ctes: str) -> str:
    return "WITH " + ",".join([PERSONS, *ctes]) + "\n" + sql


def over_clean(sql: str, *ctes: str) -> str:
    return "WITH " + ",".join([PERSONS, CLEAN, *ctes]) + "\n" + sql


def over_clean_recursive(sql: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([PERSONS, CLEAN, *ctes]) + "\n" + sql
