"""Windows over event time, on batches and streams: tumbling, sliding, session, bounded session, and SLA windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Late rows are given up ``delay`` behind the latest event; zone-less times become instants first."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return df.groupBy(F.window(ts, size), *keys).agg(*aggregates).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *_names(aggregates))


def sliding(df: DataFrame, ts: str, size: str, step: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return df.groupBy(F.window(ts, size, step), *keys).agg(*aggregates).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *_names(aggregates))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *_names(aggregates))


def bounded_sessions(df: DataFrame, ts: str, gap_seconds: int, most_seconds: int, keys: list[str]) -> DataFrame:
    """(keys, window_start, last, n): sessions that end at a gap, and are cut every ``most_seconds`` from their start."""
    by = Window.partitionBy(*keys).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce(at - F.lag(at).over(by) > gap_seconds * 1_000_000, F.lit(True))
    rows = df.withColumn("_s", F.sum(new.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", at)
    first = F.min("_at").over(Window.partitionBy(*keys, "_s"))
    rows = rows.withColumn("_part", F.floor((F.col("_at") - first) / (most_seconds * 1_000_000)))
    return rows.groupBy(*keys, "_s", "_part").agg(F.min(ts).alias("window_start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("_s", "_part")


def _names(aggregates: list[Column]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") if hasattr(a, "_jc") else str(a) for a in aggregates]
