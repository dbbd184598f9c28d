"""Match configuration: which fields are compared, how, and with what thresholds."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

# Columns created as [] rather than '' when they are missing.
LIST_COLUMNS = (
    "birth_family_name_list", "birth_first_name_list",
    "addresses_street", "addresses_complement", "addresses_city", "addresses_postal_code",
    "emails", "telephones", "all_full_names", "all_addresses",
)
# List-valued columns parsed by preprocessing.
NESTED_COLUMNS = (
    "birth_family_name_list", "birth_first_name_list",
    "addresses_street", "addresses_complement", "addresses_city", "addresses_postal_code", "addresses_country",
    "emails", "telephones",
)
# Columns kept when the sensitive filter is on.
NON_SENSITIVE_COLUMNS = (
    "id", "birth_family_name", "birth_first_name", "ins_registration_number",
    "gap_origin_id", "origin", "origin_id",
)
# Compared fields and their types.
FIELD_TYPES = {
    "sex": "Exact", "civility": "Exact", "nationality": "ShortString",
    "birth_first_name": "String", "birth_family_name": "String",
    "usage_first_name": "String", "usage_family_name": "String",
    "birth_date": "DateTime",
    "birth_city": "Exact", "birth_postal_code": "Exact", "birth_country": "Exact",
    "addresses_street": "Custom", "addresses_complement": "Custom", "addresses_city": "Custom",
    "addresses_postal_code": "Custom", "addresses_country": "Custom",
    "birth_first_name_list": "Custom", "birth_family_name_list": "Custom",
    "emails": "Custom", "telephones": "Custom",
}
# Products of fields.
INTERACTIONS = {
    "combined_full_name": ("birth_first_name_list", "birth_family_name_list"),
    "combined_full_name_birth": ("birth_first_name", "birth_family_name"),
    "combined_first_name_last_birth": ("birth_first_name_list", "birth_family_name"),
    "combined_last_name_first_birth": ("birth_first_name", "birth_family_name_list"),
    "combined_full_address": ("addresses_street", "addresses_complement", "addresses_postal_code",
                              "addresses_city", "addresses_country"),
    "combined_street_city": ("addresses_street", "addresses_city"),
    "combined_street_postal_code": ("addresses_street", "addresses_postal_code"),
    "combined_complement_city": ("addresses_complement", "addresses_city"),
    "combined_complement_postal_code": ("addresses_complement", "addresses_postal_code"),
    "combined_birth_address": ("birth_city", "birth_postal_code", "birth_country"),
}
# Fields used when the configuration names none that the data has.
FALLBACK_FIELDS = {
    "birth_family_name": "Text", "birth_first_name": "Text",
    "usage_family_name": "Text", "usage_first_name": "Text",
    "addresses_street": "Text", "addresses_postal_code": "Text",
    "civility": "Exact", "sex": "Exact",
}
# Default thresholds.
CLUSTER_THRESHOLD = 0.5
LINK_THRESHOLD = 0.5
LINK_CONFIDENCE_FILTER = 0.65

Comparator = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class FieldSpec:
    """One compared field.

    ``comparator`` (X1) overrides the comparison of the type and may be any
    function of two columns, a pandas UDF included.  ``bounds`` is the range of
    its values.  ``needs`` names the blocking predicate that two records must
    share on this field for the comparison to be other than 0.
    """

    field: str
    type: str
    has_missing: bool = True
    comparator: Comparator | None = None
    parts: tuple[str, ...] = ()
    name: str = ""
    bounds: tuple[float, float] = (0.0, float("inf"))
    needs: str | None = None

    @property
    def feature(self) -> str:
        return self.name or self.field


@dataclass(frozen=True)
class MatchConfig:
    nested_columns: tuple[str, ...] = NESTED_COLUMNS
    non_sensitive_columns: tuple[str, ...] = NON_SENSITIVE_COLUMNS
    fields: tuple[FieldSpec, ...] = field(default_factory=lambda: tuple(
        [FieldSpec(f, t) for f, t in FIELD_TYPES.items()]
        + [FieldSpec(f, "Interaction", parts=p) for f, p in INTERACTIONS.items()]))
    id_column: str = "id"
    cluster_threshold: float = CLUSTER_THRESHOLD
    link_threshold: float = LINK_THRESHOLD


def is_list_field(name: str) -> bool:
    """Fields compared as lists whatever type they are configured with."""
    return (name.startswith(("emails", "telephones", "addresses_"))
            or name.endswith(("_family_name_list", "_first_name_list")))


def load_config(path: str) -> MatchConfig:
    """Read a JSON control file (driver-side, a few kilobytes)."""
    with open(path, encoding="utf-8") as handle:
        raw = json.load(handle)
    dataset, defaults = raw.get("dataset", raw), raw.get("defaults", {})
    settings = raw.get("variables_setting") or {}
    specs = tuple(FieldSpec(name, s["type"], s.get("has missing", True), parts=tuple(s.get("interaction_variables", ())))
                  for name, s in settings.items() if isinstance(s, dict) and "type" in s)
    base = MatchConfig()
    return replace(
        base,
        nested_columns=tuple(dataset.get("list_nested_columns", base.nested_columns)),
        non_sensitive_columns=tuple(dataset.get("list_basic_non_sensitive", base.non_sensitive_columns)),
        fields=specs or base.fields,
        cluster_threshold=float(defaults.get("cluster_threshold", base.cluster_threshold)),
    )


def select_fields(columns: Iterable[str], config: MatchConfig) -> tuple[FieldSpec, ...]:
    """The configured fields that the data has; interactions need all their parts."""
    have = set(columns)

    def usable(s: FieldSpec) -> bool:
        return set(s.parts) <= have if s.type == "Interaction" else s.field in have

    chosen = tuple(replace(s, type="Custom") if is_list_field(s.field) else s for s in config.fields if usable(s))
    if chosen:
        return chosen
    return tuple(FieldSpec(f, t) for f, t in FALLBACK_FIELDS.items() if f in have)
