"""Candidate pairs from blocking keys: J1, J3, J6, U1 and the efficiency report A16.

A *rule* is a set of (predicate, field) atoms; two records are candidates when
they share a key of every atom of some rule.  One atom is a plain blocking
predicate, several make a compound block.  All rules of a record are exploded
once and matched by one equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.blockkeys import PREDICATES, with_phonetic
from twinfold.sources.lineage import stored

Atom = tuple[str, str]  # (predicate name, field)
Rule = frozenset[Atom]

MAX_BLOCK = 2_000  # records per cell: larger blocks are split, never dropped
_LONG_KEY = 64
_MANY_PAIRS = 4_000_000
_JOIN = ["rule", "key", "row", "column"]

# predicates that every non-blank value has a key for, so equal values share it
_IMPLIED_BY_EQUALITY = frozenset(("same_three_char_start", "same_five_char_start", "same_seven_char_start"))


def rule(*atoms: Atom) -> Rule:
    return frozenset(atoms)


def simplify(rules: Iterable[Rule]) -> list[Rule]:
    """Drop atoms implied by equality of the field, and rules implied by a shorter rule."""
    def tight(r: Rule) -> Rule:
        equal = {f for p, f in r if p == "whole_field"}
        return frozenset((p, f) for p, f in r if not (f in equal and p in _IMPLIED_BY_EQUALITY))

    kept: list[Rule] = []
    for r in sorted({tight(r) for r in rules}, key=lambda r: (len(r), sorted(r))):
        if not any(k <= r for k in kept):
            kept.append(r)
    return kept


def rule_keys(r: Rule) -> str:
    """The keys of one record under a rule: one part per atom, in all combinations (SQL text)."""
    parts = [PREDICATES[predicate](field) for predicate, field in sorted(r)]
    return reduce(lambda keys, part: f"flatten(transform({keys}, a -> transform({part}, b -> "
                                     f"concat_ws('\\u001f', a, b))))", parts)


def with_rule_columns(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Columns that some predicates of the rules read besides the fields themselves."""
    return with_phonetic(df, sorted({f for r in rules for p, f in r if p == "double_metaphone"}))


def block_table(df: DataFrame, rules: Sequence[Rule], id_column: str = "record_id",
                payload: Sequence[str] = (), tagged: bool = False) -> DataFrame:
    """``(id, rule, key[, payload])``, one row per record and distinct key of any rule.

    Long keys travel as their SHA-256.  With ``tagged`` each row also has ``tag``,
    its rule and key as one text, and ``before``, the smaller tags of its record, and
    ``tags``, all of them.  Without a payload the records of one id are one there.
    """
    key = f"if(length(k) <= {_LONG_KEY}, k, sha2(k, 256))"
    per_rule = ", ".join(f"struct({n} as rule, array_distinct({rule_keys(r)}) as keys)" for n, r in enumerate(rules))
    carried = ["payload"] if payload else []
    one_row = with_rule_columns(df, rules).select(
        F.col(id_column).alias("id"), *([F.struct(*payload).alias("payload")] if payload else []),
        F.expr(f"array({per_rule})").alias("blocks"))
    if not tagged:
        return (one_row.selectExpr("id", *carried, "explode(blocks) as block")
                .selectExpr("id", *carried, "block.rule as rule", "explode(block.keys) as k")
                .selectExpr("id", *carried, "rule", f"{key} as key"))
    tags = ("array_distinct(flatten(transform(blocks, b -> transform(filter(b.keys, k -> k is not null), "
            f"k -> concat(cast(b.rule as string), ':', {key}))))) as tags")
    marked = one_row.selectExpr("id", *carried, tags)
    if not payload:
        marked = marked.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))
    return (marked.selectExpr("id", *carried, "tags", "explode(tags) as tag")
            .selectExpr("id", *carried, "cast(substring_index(tag, ':', 1) as int) as rule", "substring(tag, instr(tag, ':') + 1) as key",
                        "tag", "tags", "filter(tags, t -> t < tag) as before"))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """Records per key, counted before the shuffle where possible."""
    return blocks.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("records"))


def block_work(blocks: DataFrame, max_block: int) -> DataFrame:
    """``rule, key, parts, pairs``: the keys of more than ``max_block`` records, and for each rule one row without a key for all others.

    The counts are taken in a job of their own and stored.  There are rarely
    any such keys; knowing the size of this table beforehand keeps the blocks
    themselves from being shuffled once more to meet it.
    """
    n = F.col("records").cast("double")
    counts = block_sizes(blocks).groupBy("rule", F.when(F.col("records") > max_block, F.col("key")).alias("key")).agg(
        F.max("records").alias("records"), F.sum(n * (n - 1) / 2).alias("pairs"))
    return stored(counts.selectExpr("rule", "key", f"cast(ceil(records / {max_block}) as int) as parts", "pairs"), "hot-keys")


def hot_keys(work: DataFrame) -> DataFrame:
    """``rule, key, parts``: the keys to be cut, and into how many pieces."""
    return work.filter("key is not null").select("rule", "key", "parts")


def _with_parts(blocks: DataFrame, hot: DataFrame) -> DataFrame:
    """Each row with the ``part`` of its key that it falls in, by a hash of the id."""
    return (blocks.join(hot, ["rule", "key"], "left")
            .selectExpr("*", "cast(pmod(xxhash64(id), coalesce(parts, 1)) as int) as part"))


def candidate_pairs(df: DataFrame, rules: Sequence[Rule], id_column: str = "record_id",
                    payload: Sequence[str] = (), max_block: int = MAX_BLOCK, keep: Callable[[str, str], str] | None = None) -> DataFrame:
    """The pairs ``left_id < right_id`` that share a key under some rule, each once.

    A block above ``max_block`` records becomes a triangle of cells: piece i
    meets piece j in cell (i, j), so all its pairs are still found while no
    task compares more than two pieces.  Both join sides are the same exchange.

    With ``payload`` the compared fields ride along as structs ``l`` and ``r``.
    A pair meets at every key its records share and is kept at the smallest
    of them only, so it is scored once.  ``keep`` makes the SQL of a condition on
    the compared fields of both records, whichever comes first, that pairs have to meet.
    """
    work = block_work(block_table(df, rules, id_column), max_block)
    placed = _with_parts(block_table(df, rules, id_column, payload, tagged=True), hot_keys(work))
    carried = ["payload"] if payload else []
    # cell of each piece with every other: (smaller, larger)
    cells = ("explode(transform(sequence(0, coalesce(parts, 1) - 1), "
             "j -> struct(least(part, j) as row, greatest(part, j) as column))) as cell")
    placed = (placed.selectExpr("id", *carried, "rule", "key", "before", "tags", "part", cells)
              .selectExpr("id", *carried, "rule", "key", "before", "tags", "part", "cell.row as row", "cell.column as column"))
    if (work.agg(F.sum("pairs")).first()[0] or 0) > _MANY_PAIRS:
        # few bytes have many pairs here: the number of partitions is not left to the bytes
        placed = placed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_JOIN)
    # Inside a diagonal cell ids decide the side, elsewhere the piece does.  The two tests of the
    # piece are one expression over both sides: pushed down singly they would make the sides differ.
    on = [f"a.{c} = b.{c}" for c in _JOIN] + [
        "abs(a.part - a.row) + abs(b.part - b.column) = 0", "(a.row < a.column or a.id < b.id)", *([keep("a.payload", "b.payload")] if keep else []),
        "not arrays_overlap(a.before, b.tags)"]
    joined = placed.alias("a").join(placed.alias("b"), F.expr(" and ".join(on)))
    ids = ("least(a.id, b.id) as left_id", "greatest(a.id, b.id) as right_id")
    if not payload:  # an id has one set of keys, so each pair is here once
        return joined.selectExpr(*ids)
    return joined.selectExpr(*ids, "if(a.id < b.id, a.payload, b.payload) as l",
                             "if(a.id < b.id, b.payload, a.payload) as r")


def index_base(base: DataFrame, rules: Sequence[Rule], payload: Sequence[str], id_column: str = "record_id",
               max_block: int = MAX_BLOCK, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hot keys and placed blocks of a base table; with ``keep`` stored, to serve many lookups."""
    hot = hot_keys(block_work(block_table(base, rules, id_column), max_block))
    side = _with_parts(block_table(base, rules, id_column, payload), hot)
    return hot, stored(side, "base-blocks") if keep else side


def cross_candidates(new: DataFrame, index: tuple[DataFrame, DataFrame], rules: Sequence[Rule],
                     payload: Sequence[str], id_column: str = "record_id") -> DataFrame:
    """Pairs of a new and a base record that share a key: ``query_id, record_id, l, r``.

    Large base blocks are cut into pieces and the new side is repeated per
    piece.  Which side is broadcast, if any, is left to the measured sizes.
    """
    hot, base_side = index
    new_side = _with_parts(block_table(new, rules, id_column, payload), hot).selectExpr(
        "id", "payload", "rule", "key", "explode(sequence(0, coalesce(parts, 1) - 1)) as part")
    on = "a.rule = b.rule and a.key = b.key and a.part = b.part"
    return (new_side.alias("a").join(base_side.alias("b"), F.expr(on))
            .selectExpr("a.id as query_id", "b.id as record_id", "a.payload as l", "b.payload as r"))


def hydrate(pairs: DataFrame, records: DataFrame, fields: Sequence[str],
            id_column: str = "record_id") -> DataFrame:
    """Fetch the compared fields of both records as structs ``l`` and ``r``."""
    side = records.select(F.col(id_column).alias("id"), F.struct(*(F.col(f) for f in fields)).alias("v"))
    left = side.select(F.col("id").alias("left_id"), F.col("v").alias("l"))
    right = side.select(F.col("id").alias("right_id"), F.col("v").alias("r"))
    return pairs.join(left, "left_id").join(right, "right_id")


def blocking_efficiency(df: DataFrame, rules: Sequence[Rule], pairs: DataFrame,
                        id_column: str = "record_id") -> DataFrame:
    """A16 per rule: blocks, largest block, comparisons; with the share of all pairs avoided."""
    n = df.agg(F.count(F.lit(1))).scalar().cast("double")
    total = pairs.agg(F.count(F.lit(1))).scalar()
    size = F.col("records")
    per_rule = (block_sizes(block_table(df, rules, id_column)).groupBy("rule")
                .agg(F.count(F.lit(1)).alias("blocks"), F.max(size).alias("largest_block"),
                     F.sum((size * (size - 1) / 2).cast("bigint")).alias("comparisons")))
    return per_rule.select("rule", "blocks", "largest_block", "comparisons",
                           total.alias("distinct_pairs"), (n * (n - 1) / 2).cast("bigint").alias("all_pairs"),
                           (1 - total / (n * (n - 1) / 2)).alias("reduction_ratio"))


def pair_completeness(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """How many true pairs the candidates contain."""
    found = truth.join(pairs.withColumn("hit", F.lit(1)), ["left_id", "right_id"], "left")
    return found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found_pairs")).selectExpr(
        "*", "round(found_pairs / true_pairs, 6) as completeness")
