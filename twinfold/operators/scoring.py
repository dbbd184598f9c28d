"""Pair features, the logistic score and the agreements a score calls for."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.config import FieldSpec
from twinfold.functions import similarity as sim
from twinfold.operators.blocking import Rule, candidate_pairs, simplify
from twinfold.operators.nearness import MOST, Nearness, field_values, near_pairs, with_near_keys
from twinfold.sources.lineage import stored

MISSING = "__missing"
_TEXT_TYPES = ("String", "ShortString", "Text")


@dataclass(frozen=True)
class MatchModel:
    """A logistic model over pair features: ``score = 1 / (1 + exp(-(bias + Σ weight·feature)))``."""

    fields: tuple[FieldSpec, ...]
    weights: Mapping[str, float]
    bias: float

    def __post_init__(self):
        unknown = set(self.weights) - set(feature_names(self.fields))
        if unknown:
            raise ValueError(f"weights of features that the fields do not have: {sorted(unknown)}")

    @property
    def columns(self) -> list[str]:
        """The record columns the model reads."""
        return list(dict.fromkeys(s.field for s in self.fields if s.type != "Interaction"))


def _comparison(spec: FieldSpec) -> Column:
    left, right = f"l.{spec.field}", f"r.{spec.field}"
    if spec.comparator is not None:
        return spec.comparator(F.col(left), F.col(right))
    if spec.type in sim.NATIVE:
        return F.expr(sim.NATIVE[spec.type](left, right))
    if spec.type in _TEXT_TYPES:
        return sim.affine_gap()(left, right)
    if spec.type == "Custom":
        return sim.lists_similar(spec.field)
    raise ValueError(f"unknown field type: {spec.type}")


def _blank(spec: FieldSpec, types: Mapping[str, T.DataType], left: str = "l", right: str = "r") -> str:
    """SQL: whether the field is null or empty on either side."""
    empty = "size({0}) = 0" if isinstance(types[spec.field], T.ArrayType) else "{0} = ''"
    return " or ".join(f"{side}.{spec.field} is null or " + empty.format(f"{side}.{spec.field}") for side in (left, right))


def add_features(pairs: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    """One column per feature from the structs ``l`` and ``r``.

    Where a side is missing the feature is 0 and its indicator 1 (G8).  An
    interaction is the product of its parts (G7).
    """
    types = {f.name: f.dataType for f in pairs.schema["l"].dataType}
    plain = [s for s in fields if s.type != "Interaction"]
    near = sim.with_near_items(pairs, [s.field for s in plain if s.type == "Custom" and s.comparator is None])
    compared = near.withColumns({f"__{s.feature}": _comparison(s) for s in plain})

    def missing(s: FieldSpec) -> str:
        return f"({_blank(s, types)} or __{s.feature} is null)"

    features = [f"if({missing(s)}, 0.0D, cast(__{s.feature} as double)) as {s.feature}" for s in plain]
    features += [f"if({missing(s)}, 1.0D, 0.0D) as {s.feature}{MISSING}" for s in plain if s.has_missing]
    out = compared.selectExpr(*pairs.columns, *features)
    products = [f"{' * '.join(s.parts)} as {s.feature}" for s in fields if s.type == "Interaction"]
    return out.selectExpr("*", *products) if products else out


def feature_names(fields: Sequence[FieldSpec]) -> list[str]:
    """Feature columns in order: values, their indicators, then interactions."""
    plain = [s for s in fields if s.type != "Interaction"]
    names = [n for s in plain for n in ([s.feature, s.feature + MISSING] if s.has_missing else [s.feature])]
    return names + [s.feature for s in fields if s.type == "Interaction"]


def score_column(model: MatchModel) -> Column:
    """M3: the probability of a duplicate from the feature columns."""
    terms = [f"{model.weights[name]!r}D * {name}" for name in feature_names(model.fields) if model.weights.get(name)]
    return F.expr(f"1.0D / (1.0D + exp(-({model.bias!r}D{''.join(' + ' + t for t in terms)})))")


def score_pairs(pairs: DataFrame, model: MatchModel) -> DataFrame:
    """Features and ``score`` for hydrated pairs."""
    return add_features(pairs, model.fields).withColumn("score", score_column(model))


def keep_matches(scored: DataFrame, threshold: float) -> DataFrame:
    """The pairs at or above the threshold."""
    return scored.filter(F.col("score") >= threshold)


def emit_pairs(scored: DataFrame, threshold: float) -> DataFrame:
    """``left_id, right_id, score, is_duplicate``."""
    return scored.select("left_id", "right_id", "score", (F.col("score") >= threshold).alias("is_duplicate"))


def _range(spec: FieldSpec, agree: frozenset[str], near: Mapping[str, float | None]) -> tuple[float, float]:
    """Least and largest value of a comparison when only ``agree`` fields agree."""
    low, high = bounds(spec)
    if spec.feature in agree or needs(spec, near) is None:
        return low, high
    return (near[spec.feature], high) if near.get(spec.feature) is not None else (0.0, 0.0)


def _contribution(model: MatchModel, spec: FieldSpec, agree: frozenset[str], near: Mapping[str, float | None]) -> float:
    """Largest amount a field can add to the logit when only ``agree`` fields agree."""
    by_name = {s.feature: s for s in model.fields}
    weight = model.weights.get(spec.feature, 0.0)
    if not weight and spec.type == "Interaction":
        return 0.0
    if spec.type == "Interaction":  # a missing part makes it 0
        ranges = [_range(by_name[p], agree, near) for p in spec.parts]
        return max(0.0, *(weight * math.prod(r[k] for r in ranges) if all(r[1] for r in ranges) else 0.0 for k in (0, 1)))
    low, high = _range(spec, agree, near)
    missing = model.weights.get(spec.feature + MISSING, 0.0) if spec.has_missing else 0.0
    return max(weight * low, weight * high if weight else 0.0, missing)


def needs(spec: FieldSpec, near: Mapping[str, float | None] | None = None) -> str | None:
    """The predicate two records must share for the field to compare above 0, or, as a distance, within its cutoff."""
    if spec.comparator is None and spec.needs is None:
        if near and spec.feature in near:
            return "near"
        return {"Exact": "whole_field", "Overlap": "common_set_element"}.get(spec.type)
    return spec.needs


def bounds(spec: FieldSpec) -> tuple[float, float]:
    if spec.comparator is None and spec.type in ("Exact", "Overlap", "Edit", "Custom"):
        return (0.0, 1.0)
    if spec.comparator is None and spec.type in _TEXT_TYPES:
        return (sim.MATCH / 2, sim.GAP_OPEN + sim.GAP_EXTEND)  # equal texts, and no letter in common
    return spec.bounds


def _goal(threshold: float) -> float:
    return math.log(threshold / (1 - threshold)) if 0 < threshold < 1 else (-math.inf if threshold <= 0 else math.inf)


def near_cutoffs(model: MatchModel, threshold: float) -> dict[str, float | None]:
    """Features that a similarity join can ask for: lists of near items (None), and texts with the largest useful distance.

    Beyond that distance the text alone keeps a pair from the threshold, or it is the largest that the join can find.
    """
    goal = _goal(threshold)
    every = frozenset(s.feature for s in model.fields)
    near: dict[str, float | None] = {}
    best = model.bias + sum(_contribution(model, s, every, {}) for s in model.fields)
    for s in model.fields:
        weight = model.weights.get(s.feature, 0.0)
        if s.comparator is not None or s.needs is not None:
            continue
        if s.type == "Custom":
            near[s.feature] = None
        elif s.type in _TEXT_TYPES and weight < 0 and best >= goal:
            near[s.feature] = min(MOST, bounds(s)[0] + (best - goal + 1e-9) / -weight)
    return near


def needed_agreements(model: MatchModel, threshold: float, near: Mapping[str, float | None] | None = None) -> list[Rule]:
    """The minimal sets of agreements without one of which no pair reaches the threshold.

    An empty set means the model can accept a pair that agrees on no key.  The
    search is over the handful of configured fields, never over data.  ``near``
    names the features whose near agreement can be joined on.
    """
    near, goal = near or {}, _goal(threshold)
    keyed = [s for s in model.fields if s.type != "Interaction" and needs(s, near) is not None]
    found: list[frozenset[str]] = []
    for size in range(len(keyed) + 1):
        for chosen in combinations((s.feature for s in keyed), size):
            agree = frozenset(chosen)
            if any(f <= agree for f in found):
                continue
            if model.bias + sum(_contribution(model, s, agree, near) for s in model.fields) >= goal - 1e-9:
                found.append(agree)
    by_name = {s.feature: s for s in keyed}
    return [frozenset((needs(by_name[f], near), by_name[f].field) for f in agree) for agree in found]


_DATE = "__date_"


def _with_dates(records: DataFrame, fields: Sequence[FieldSpec]) -> tuple[DataFrame, list[str]]:
    """``records`` with the parsed form of the compared dates, and the names of these columns: read once a record, not once a pair."""
    parsed = {_DATE + s.field: F.expr(f"try_to_date({s.field}, 'yyyy-MM-dd')") for s in fields if s.type == "DateTime" and s.comparator is None}
    return (records.withColumns(parsed) if parsed else records), list(parsed)


def within_reach(model: MatchModel, threshold: float, types: Mapping[str, T.DataType], left: str = "l", right: str = "r",
                 near_items: bool = False) -> str | None:
    """SQL: whether a pair can reach the threshold, told in the JVM before texts and list items are compared; None if nothing is gained.

    A field adds the most it can: exactly what it adds where its comparison is native, for a text the least
    distance that its edit distance allows, and the bounds of its type otherwise.  With ``near_items`` the columns
    of :func:`sim.with_near_items` tell which lists may have a near item.
    """
    plain, goal = [s for s in model.fields if s.type != "Interaction"], _goal(threshold)
    own = [s for s in plain if s.comparator is not None and model.weights.get(s.feature)]
    if math.isinf(goal) or any(math.isinf(x) for s in own for x in s.bounds) or all(s.type in sim.NATIVE and s.comparator is None for s in plain):
        return None
    every = frozenset(s.feature for s in model.fields)

    def most(s: FieldSpec) -> str:
        weight = model.weights.get(s.feature, 0.0)
        if s.type == "Interaction":
            return f"{_contribution(model, s, every, {})!r}D"
        absent = model.weights.get(s.feature + MISSING, 0.0) if s.has_missing else 0.0
        l, r, blank = f"{left}.{s.field}", f"{right}.{s.field}", _blank(s, types, left, right)
        low, high = bounds(s) if weight else (0.0, 0.0)
        ends = f"{max(weight * low, weight * high) if weight else 0.0!r}D"
        if s.comparator is not None:  # its value may be null where neither side is blank
            return f"greatest({ends}, {absent!r}D)"
        if s.type in sim.NATIVE:
            dates = s.type == "DateTime" and _DATE + s.field in types
            value = f"sqrt(abs(datediff({left}.{_DATE}{s.field}, {right}.{_DATE}{s.field})))" if dates else sim.NATIVE[s.type](l, r)
            return f"if({blank}, {absent!r}D, coalesce({weight!r}D * {value}, {absent!r}D))"
        if s.type in _TEXT_TYPES and weight < 0:
            ends = f"{weight!r}D * {sim.least_affine_gap(l, r)}"
        elif s.type == "Custom" and weight > 0 and near_items:
            ends = f"if(arrays_overlap({l}, {r}) or size(__near_{s.field}) > 0, {ends}, 0.0D)"
        return f"if({blank}, {absent!r}D, {ends})"

    return f"{' + '.join([f'{model.bias!r}D', *map(most, model.fields)])} >= {goal - 1e-6!r}D"


def matching_rules(blocking: Sequence[Rule], model: MatchModel, threshold: float, near: Mapping[str, float | None] | None = None,
                   sizes: Mapping[str, int] | None = None) -> list[Rule]:
    """Blocking rules tightened by what the score calls for.

    A pair that shares a block key and reaches the threshold satisfies at
    least one of the returned rules, so joining on them loses no match, while a
    key shared by a large part of the table is only used together with further
    agreements.  Of several near agreements a rule takes one, that of the field
    with the fewest near pairs by ``sizes``: each would multiply the keys.
    """
    def loosened(needed: Rule) -> Rule:
        fields = sorted((f for p, f in needed if p == "near"), key=lambda f: ((sizes or {}).get(f, 0), f))
        return frozenset(a for a in needed if a[0] != "near" or a[1] == fields[0])

    return simplify(b | loosened(n) for b in blocking for n in needed_agreements(model, threshold, near))


def tightened(blocking: Sequence[Rule], model: MatchModel, threshold: float, *frames: DataFrame,
              id_column: str = "record_id") -> tuple[list[Rule], tuple[DataFrame, ...]]:
    """:func:`matching_rules` with near agreements, and ``frames`` with the keys that they read.

    The similarity joins run over the values of all frames together, once for each field that a rule may ask for.
    """
    near = near_cutoffs(model, threshold)
    field_of = {s.feature: s.field for s in model.fields}
    wanted = {f for n in needed_agreements(model, threshold, near) for p, f in n if p == "near"}
    joined, sizes = {}, {}
    for feature, cutoff in near.items():
        field = field_of[feature]
        if field in wanted and field not in joined:
            values = reduce(DataFrame.union, [field_values(f, field) for f in frames])
            joined[field] = stored(near_pairs(values, Nearness(cutoff)), "near-pairs")
            sizes[field] = joined[field].count()
    rules = matching_rules(blocking, model, threshold, near, sizes)
    read = {f for r in rules for p, f in r if p == "near"}
    return rules, tuple(with_near_keys(f, {k: v for k, v in joined.items() if k in read}, id_column) for f in frames)


def matching_pairs(records: DataFrame, blocking: Sequence[Rule], model: MatchModel, threshold: float,
                   id_column: str = "record_id") -> DataFrame:
    """J1 → features → M3 → P18: ``left_id, right_id, score`` of all matching candidates.

    The compared fields travel with the block keys, so pairs are scored and
    filtered inside the join stage; only matches are shuffled again.  Pairs that
    surely stay below the threshold leave before their texts are compared.
    """
    rules, (records,) = tightened(blocking, model, threshold, records, id_column=id_column)
    if not rules:  # no pair can reach the threshold
        return (records.select(F.col(id_column).alias("left_id"), F.col(id_column).alias("right_id"),
                               F.lit(0.0).alias("score")).filter(F.lit(False)))
    records, dates = _with_dates(records, model.fields)
    types = {f.name: f.dataType for f in records.schema}
    if within_reach(model, threshold, types) is None:
        pairs = candidate_pairs(records, rules, id_column, payload=model.columns)
    else:
        lists = [s.field for s in model.fields if s.type == "Custom" and s.comparator is None]
        pairs = candidate_pairs(records, rules, id_column, payload=[*model.columns, *dates], keep=lambda a, b: within_reach(model, threshold, types, a, b))
        # stored, as the filter on list items would be pushed into the join and read for every candidate
        pairs = sim.with_near_items(stored(pairs, "in-reach"), lists).filter(within_reach(model, threshold, types, near_items=True)).select("left_id", "right_id", "l", "r")
    scored = keep_matches(score_pairs(pairs, model), threshold)
    return scored.groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
