"""Overlap resolution of half-open spans.

Chained strategies are windows over each key; direct ones depend on what was kept before, so they fold the sorted spans of a key.
A key's spans should be a document's or a user's, not a whole table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("longest", "earliest", "earliest_longest")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def _order(strategy: str, start: str, end: str, ord_col: str) -> list[Column]:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return [F.col(start).asc(), *([F.col(end).desc()] if strategy == "earliest_longest" else []), F.col(ord_col).asc()]


def resolve(df: DataFrame, keys: list[str], strategy: str = "longest", direct_only: bool = False, start: str = "start", end: str = "end", ord_col: str = "ord") -> DataFrame:
    """The spans of each key that stay. ``ord_col`` says which of equal spans came first."""
    order = _order(strategy, start, end, ord_col)
    return _fold(df, keys, strategy, order, start, end, ord_col) if direct_only else _windows(df, keys, strategy, order, start, end, ord_col)


def _windows(df: DataFrame, keys: list[str], strategy: str, order: list[Column], start: str, end: str, ord_col: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    if strategy != "longest":
        return df.withColumn("_reach", reach).where(F.col(start) >= F.coalesce("_reach", F.lit(-1))).drop("_reach")
    runs = df.withColumn("_reach", reach).withColumn("_run", F.sum(F.when(F.col(start) < F.col("_reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(*keys, "_run").orderBy((F.col(start) - F.col(end)).asc(), *order)
    return runs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_reach", "_run", "_rank")


def _fold(df: DataFrame, keys: list[str], strategy: str, order: list[Column], start: str, end: str, ord_col: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = (-F.col(end) if strategy == "earliest_longest" else F.lit(0)).alias("_b")
    row = F.struct(F.col(start).alias("_a"), last, F.col(ord_col).alias("_c"), F.struct(*rest).alias("row"))
    sorted_rows = F.array_sort(F.collect_list(row))
    size = lambda r: r["row"][end] - r["row"][start]

    def longest(kept: Column, r: Column) -> Column:
        top = F.element_at(kept, -1)
        free = (F.size(kept) == 0) | (r["row"][start] >= F.coalesce(top["row"][end], F.lit(None)))
        bigger = size(r) > size(top)
        return F.when(free, F.concat(kept, F.array(r))).when(bigger, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(r))).otherwise(kept)

    def earliest(kept: Column, r: Column) -> Column:
        reach = F.coalesce(F.try_element_at(kept, F.lit(-1))["row"][end], F.lit(-1))
        return F.when(r["row"][start] >= reach, F.concat(kept, F.array(r))).otherwise(kept)

    step = longest if strategy == "longest" else earliest
    grouped = df.groupBy(*keys).agg(sorted_rows.alias("_rows"))
    none = F.slice("_rows", 1, 0)
    if strategy == "longest":
        # the first span is always kept to begin with
        folded = F.aggregate(F.slice("_rows", 2, F.greatest(F.size("_rows"), F.lit(1))), F.slice("_rows", 1, 1), step)
    else:
        folded = F.aggregate("_rows", none, step)
    return grouped.select(*keys, F.explode(folded).alias("_k")).select(*keys, "_k.row.*").select(*df.columns)
