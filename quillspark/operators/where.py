"""WHERE clauses from configuration: nested AND / OR of (column, operator, value), as Columns, never as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_or_many(one: Callable[[Column, object], Column], many: Callable[[Column, list], Column]) -> Callable[[Column, object], Column]:
    def of(column: Column, value: object) -> Column:
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        return one(column, values[0]) if len(values) == 1 else many(column, values)

    return of


def _is(column: Column, value: object) -> Column:
    return column.isNull() if value is None else column == value


def _is_not(column: Column, value: object) -> Column:
    return column.isNotNull() if value is None else column != value


OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": _is,
    "ne": _is_not,
    "is": _is,
    "is not": _is_not,
    "lt": lambda c, v: c < v,
    "gt": lambda c, v: c > v,
    "le": lambda c, v: c <= v,
    "ge": lambda c, v: c >= v,
    "in": _one_or_many(_is, lambda c, v: c.isin(v)),
    "not in": _one_or_many(_is_not, lambda c, v: ~c.isin(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
    "like": lambda c, v: c.like(v),
    "not like": lambda c, v: ~c.like(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
}


def condition(column: str, operator: str, value: object) -> Column:
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    return OPERATORS[operator](F.col(column), value)


def build(config: Mapping | Sequence) -> Column | None:
    """A list is an AND of its members, ``{"and": [...]}`` and ``{"or": [...]}`` nest, ``{"column", "operator", "value"}`` is a leaf. Empty: None, no filter."""
    if isinstance(config, Mapping) and "column" in config:
        return condition(config["column"], config.get("operator", "eq"), config.get("value"))
    if isinstance(config, Mapping):
        parts = [_joined(k.lower(), build_all(v)) for k, v in config.items()]
    else:
        parts = build_all(config)
    return _joined("and", [p for p in parts if p is not None])


def build_all(members: Sequence) -> list[Column]:
    return [c for c in map(build, members) if c is not None]


def _joined(how: str, parts: list[Column]) -> Column | None:
    if how not in ("and", "or"):
        raise ValueError(f"unknown combination {how!r}")
    return reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), parts) if parts else None
