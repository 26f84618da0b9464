"""As-of joins and range scans without Python: both sides in one sorted window for each key.

``floor``: greatest key <= x; ``ceiling``: smallest >= x; ``lower`` and ``higher``: strict. Of equal right keys the last (by ``tie``) wins.
A range join meets within buckets of the key, so it stays an equi-join at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("floor", "ceiling", "lower", "higher")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], direction: str = "floor", right_on: str | None = None, tie: str | None = None, prefix: str = "r_") -> DataFrame:
    """Every left row with the right row nearest in the direction (``prefix`` before its columns), or nulls."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    right_on = right_on or on
    back = direction in ("floor", "lower")
    names = [c for c in right.columns if c not in by]
    value = F.struct(*[F.col(c).alias(prefix + c) for c in names])
    # on equal keys a right row counts for floor and ceiling, so it must stand on the window's side of the left row
    right_first = 0 if direction in ("floor", "higher") else 2
    tie_of = F.col(tie).cast("double") if tie else F.lit(0.0)
    a = left.select(*by, F.col(on).alias("_k"), F.lit(1).alias("_side"), F.lit(0.0).alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(*by, F.col(right_on).alias("_k"), F.lit(right_first).alias("_side"), tie_of.alias("_tie"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), value.alias("_v"))
    order = Window.partitionBy(*by).orderBy("_k", "_side", "_tie")
    if back:
        found = F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_k"), F.col("_side"), F.col("_tie").desc()).rowsBetween(0, Window.unboundedFollowing))
    rows = a.unionByName(b).withColumn("_found", found).where("_side = 1")
    return rows.select("_row.*", *[F.col("_found")[prefix + c].alias(prefix + c) for c in names])


def range_scan(df: DataFrame, key: str, start: object = None, end: object = None) -> DataFrame:
    """Rows with ``start <= key < end``; an open side is None. The filter reaches the scan."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    return df.where(F.col(key) < F.lit(end)) if end is not None else df


def range_join(points: DataFrame, ranges: DataFrame, key: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with ``start <= key < end``: ranges go to every bucket of ``width`` they touch, points to theirs."""
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    wide = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(start), F.greatest(bucket(end), bucket(start)))))
    return points.withColumn("_bucket", bucket(key)).join(wide, "_bucket").where((F.col(key) >= F.col(start)) & (F.col(key) < F.col(end))).drop("_bucket")
