"""Grouping, inversion, flattening and partition of collections."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_lists(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """(key, first position, values in input order); groups in order of their first position."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("_v"))
    return rows.select(key, F.get("_v", F.lit(0))[position].alias("first"), F.transform("_v", lambda x: x[value]).alias("values"))


def invert_map(df: DataFrame, column: str) -> DataFrame:
    """(value, its keys, sorted) over all rows' maps."""
    return df.select(F.explode(column).alias("k", "v")).groupBy("v").agg(F.array_sort(F.collect_set("k")).alias("keys"))


def attribute_sets(df: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """A map from each kind to the set of its values, for each key."""
    sets = df.groupBy(*keys, kind).agg(F.array_sort(F.collect_set(value)).alias("_s"))
    return sets.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_s")))).alias("attrs"))


def flatten(column: Column) -> Column:
    return F.flatten(column)


def partition(column: Column, condition: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(kept, removed): members that don't and do meet the condition, both in order."""
    return F.filter(column, lambda x: ~F.coalesce(condition(x), F.lit(False))), F.filter(column, lambda x: F.coalesce(condition(x), F.lit(False)))


def sorted_entries(column: Column) -> Column:
    return F.array_sort(F.map_entries(column))


def merge_by_start(a: Column, b: Column) -> Column:
    """Two span arrays in order of their starts."""
    return F.array_sort(F.concat(a, b), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))


def map_get(column: Column, key: object, default: Column | None = None) -> Column:
    got = F.try_element_at(column, F.lit(key))
    return F.coalesce(got, default) if default is not None else got


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def typed_attribute(value: Mapping) -> object:
    """A key-value store's tagged value: N is an int if integral, else a float."""
    (tag, x), = value.items()
    if tag == "N":
        return int(float(x)) if float(x) == int(float(x)) else float(x)
    if tag == "L":
        return [typed_attribute(v) for v in x]
    if tag == "M":
        return {k: typed_attribute(v) for k, v in x.items()}
    return None if tag == "NULL" else set(x) if tag in ("SS", "NS") else x


def json_number(text: Column) -> tuple[Column, Column]:
    """(bigint if the number is integral, double otherwise) of a number's text."""
    x = text.try_cast("double")
    return F.when(x == F.floor(x), x.cast("bigint")), F.when(x != F.floor(x), x)
