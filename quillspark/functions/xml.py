"""XML columns: values, repeated nodes, and template-like transformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value(xml: Column, path: str) -> Column:
    return F.xpath_string(xml, F.lit(path))


def values(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def each(df: DataFrame, column: str, path: str, name: str = "value") -> DataFrame:
    """A row for each node, with its position from 1."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(values(F.col(column), path)).alias("_p", name)).select(*rest, (F.col("_p") + 1).alias("position"), name)


def joined(xml: Column, path: str, separator: str = " ") -> Column:
    """All nodes of a path, as a predicate on the position of the sequence itself selects them."""
    return F.concat_ws(separator, values(xml, path))


def nth(xml: Column, path: str, n: Column | int) -> Column:
    return F.try_element_at(values(xml, path), F.lit(n) if isinstance(n, int) else n)


def zipped(xml: Column, left: str, right: str) -> Column:
    """Two sequences paired by position."""
    return F.arrays_zip(values(xml, left).alias("left"), values(xml, right).alias("right"))
