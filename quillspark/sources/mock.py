"""Mock rows from a schema of generators, the same for the same seed whatever the partitions."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


class Provider(Protocol):
    """A pluggable generator."""

    def supports(self, spec: object) -> bool: ...

    def column(self, spec: object, draw) -> Column: ...


def _draws(seed: int, path: str):
    """Uniform numbers in [0, 1) for a field; ``n`` tells apart the draws of one field."""
    return lambda n=0: F.pmod(F.xxhash64(F.lit(seed), F.lit(path), "id", F.lit(n) if isinstance(n, int) else n), F.lit(1 << 53)) / F.lit(float(1 << 53))


def generator(spec: object, seed: int, path: str = "", providers: tuple[Provider, ...] = ()) -> Column:
    """``str(min,max)``, ``num(min,max)``, ``enum(a,b)``, ``bool()``, a dict (an object, or ``{type: array, items, size}``), anything else is constant. ``{"value": spec, "null": share}`` is nullable."""
    draw = _draws(seed, path)
    for p in providers:
        if p.supports(spec):
            return p.column(spec, draw)
    if isinstance(spec, dict):
        if set(spec) == {"value", "null"}:
            return F.when(draw(-1) >= spec["null"], generator(spec["value"], seed, path, providers))
        if spec.get("type") == "array":
            return F.array(*[generator(spec["items"], seed, f"{path}[{i}]", providers) for i in range(spec.get("size", 3))])
        return F.struct(*[generator(v, seed, f"{path}.{k}", providers).alias(k) for k, v in spec.items()])
    m = re.fullmatch(r"\s*(str|num|enum|bool)\((.*)\)\s*", spec, re.S) if isinstance(spec, str) else None
    if not m:
        return F.lit(spec)
    args = [a.strip() for a in m[2].split(",")] if m[2].strip() else []
    if m[1] == "bool":
        return draw() < 0.5
    if m[1] == "enum":
        return F.element_at(F.array(*map(F.lit, args)), (F.floor(draw() * len(args)) + 1).cast("int"))
    low, high = (float(a) for a in args)
    if m[1] == "num":
        whole = all(re.fullmatch(r"-?\d+", a) for a in args)
        return (F.floor(draw() * (high - low + 1)) + int(low)).cast("long") if whole else draw() * (high - low) + low
    size = (F.floor(draw() * (high - low + 1)) + int(low)).cast("int")
    letter = lambda i: F.substring(F.lit(LETTERS), (F.floor(draw(i + 1) * len(LETTERS)) + 1).cast("int"), F.lit(1))
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(1), size), letter), "")).otherwise("")


def rows(spark: SparkSession, schema: dict[str, object], n: int, seed: int = 42, providers: tuple[Provider, ...] = ()) -> DataFrame:
    return spark.range(n).select(*[generator(spec, seed, name, providers).alias(name) for name, spec in schema.items()])
