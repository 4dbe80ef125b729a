"""Column specs: the metadata a table is generated from."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace

from synthtab.functions.distributions import hint_for_skewness

NUMERIC_TYPES = ("numeric", "integer")


@dataclass(frozen=True)
class ColumnSpec:
    name: str = "col"
    data_type: str = "text"
    distribution_hint: str | None = None
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    skewness: float | None = None
    null_ratio: float | None = None
    precision: float | None = None
    true_ratio: float | None = None
    min_date: str | None = None
    max_date: str | None = None
    template: str | None = None
    description: str | None = None

    @classmethod
    def of(cls, source: "ColumnSpec | Mapping") -> "ColumnSpec":
        """From a mapping; the name may be called ``column_name``."""
        if isinstance(source, ColumnSpec):
            return source
        known = {f.name for f in fields(cls)}
        values = {k: v for k, v in source.items() if k in known and v is not None}
        if source.get("column_name") is not None:
            values["name"] = source["column_name"]
        return cls(**values)

    def as_dict(self) -> dict:
        out = {"column_name": self.name, "data_type": self.data_type}
        for f in fields(self):
            if f.name not in ("name", "data_type") and getattr(self, f.name) is not None:
                out[f.name] = getattr(self, f.name)
        return out

    @property
    def kind(self) -> str:
        return self.data_type.lower()

    @property
    def is_numeric(self) -> bool:
        return self.kind in NUMERIC_TYPES

    @property
    def hint(self) -> str:
        """The stated distribution, or the one the skewness suggests."""
        return self.distribution_hint or hint_for_skewness(self.skewness or 0.0)

    def with_(self, **changes) -> "ColumnSpec":
        return replace(self, **changes)


def as_specs(columns: Iterable[ColumnSpec | Mapping]) -> list[ColumnSpec]:
    return [ColumnSpec.of(c) for c in columns]


def last_wins(specs: Iterable[ColumnSpec]) -> list[ColumnSpec]:
    """A repeated name replaces the earlier spec but keeps its place."""
    by_name: dict[str, ColumnSpec] = {}
    for spec in specs:
        by_name[spec.name] = spec
    return list(by_name.values())


# Schemas used when neither the caller nor the catalog has one.
GENERIC_SCHEMAS: dict[str, list[ColumnSpec]] = {
    "e-commerce": [
        ColumnSpec("order_id", "text"),
        ColumnSpec("customer_id", "text"),
        ColumnSpec("product_name", "text"),
        ColumnSpec("price", "numeric", "powerlaw", mean=50.0, std=30.0, min=0.99, max=500.0),
        ColumnSpec("quantity", "integer", "uniform", mean=2.0, std=1.5, min=1, max=10),
        ColumnSpec("order_date", "datetime"),
        ColumnSpec("shipping_address", "text"),
    ],
    "healthcare": [
        ColumnSpec("patient_id", "text"),
        ColumnSpec("age", "numeric", mean=55.0, std=18.0, min=0, max=100),
        ColumnSpec("diagnosis_code", "text"),
        ColumnSpec("lab_result", "numeric", "lognormal", mean=100.0, std=30.0, min=0, max=500),
        ColumnSpec("admission_date", "datetime"),
        ColumnSpec("discharge_date", "datetime"),
    ],
}
OTHER_SCHEMA = [
    ColumnSpec("id", "text"),
    ColumnSpec("value", "numeric", mean=50.0, std=20.0, min=0, max=100),
]


def generic_schema(domain: str) -> list[ColumnSpec]:
    return list(GENERIC_SCHEMAS.get(domain, OTHER_SCHEMA))


def resolve_schema(domain: str, specs=None, catalog=None) -> list[ColumnSpec]:
    """The caller's specs, else the catalog's for the domain, else the generic ones."""
    if specs:
        return as_specs(specs)
    found = catalog.domain_specs(domain) if catalog is not None else None
    return found or generic_schema(domain)


# ---- edited schemas --------------------------------------------------------


def clean_name(name: str | None, most: int | None = None) -> str:
    """Drop characters other than word characters, ``-`` and space; cut at ``most`` characters if given."""
    kept = re.sub(r"[^\w\- ]", "", name or "")[:most]
    return kept if kept.strip() else "column"


def with_defaults(spec: ColumnSpec) -> ColumnSpec:
    """Fill in what a numeric column leaves out."""
    if spec.kind != "numeric":
        return spec
    return spec.with_(
        mean=50.0 if spec.mean is None else spec.mean,
        std=20.0 if spec.std is None else spec.std,
        min=0.0 if spec.min is None else spec.min,
        max=100.0 if spec.max is None else spec.max,
    )


def check_specs(specs: list[ColumnSpec]) -> None:
    """Raise ``ValueError`` for an empty schema or impossible numeric bounds."""
    if not specs:
        raise ValueError("at least one column is required")
    for spec in specs:
        if spec.kind != "numeric":
            continue
        low = 0 if spec.min is None else spec.min
        high = 100 if spec.max is None else spec.max
        if low >= high:
            raise ValueError(f"column '{spec.name}': min ({low}) must be less than max ({high})")
        if spec.std is not None and spec.std < 0:
            raise ValueError(f"column '{spec.name}': std cannot be negative")
