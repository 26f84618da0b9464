"""Files: listings, whole texts, JSON, TOML, XML, date partitions. All but small resources are read by Spark's own readers."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resource_json(path: str | Path) -> object:
    """A small JSON resource on the driver; bad JSON is a RuntimeError."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise RuntimeError(f"can't load {path}") from e


def resource_toml(path: str | Path) -> dict:
    try:
        return tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise RuntimeError(f"can't load {path}") from e


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of a file, or of all files below a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "modificationTime")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders that hold files."""
    return listing(spark, path).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()


def texts(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(path, text) of each file below a path: decoded as ``encoding``, else as UTF-8; files that are neither are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    utf8 = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.decode("content", "UTF-8"))
    first = F.expr(f"try_cast(decode(content, '{encoding}') as string)") if encoding and encoding.upper() not in ("UTF-8", "UTF8") else utf8
    return files.select("path", F.coalesce(first, utf8).alias("text")).where("text is not null")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def write_xml(df: DataFrame, path: str, root_tag: str = "rows", row_tag: str = "row") -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root_tag).option("rowTag", row_tag).save(path)


def partitions_between(df: DataFrame, column: str, first: Column, last: Column) -> DataFrame:
    """Rows of date partitions within bounds; on a partition column Spark lists only those folders."""
    return df.where(F.col(column).between(first, last))


def render_rows(df: DataFrame, how: str, columns: list[str] | None = None) -> DataFrame:
    """One text for each row: ``json``, ``csv``, ``sep(x)``, or a template with ``{{column}}``."""
    from quillspark.functions.text import render

    columns = columns or df.columns
    if "{{" in how:
        out = render(how, **{c: F.col(c) for c in df.columns})
    elif how == "json":
        out = F.to_json(F.struct(*columns))
    elif how == "csv":
        out = F.to_csv(F.struct(*columns))
    elif how.startswith("sep(") and how.endswith(")"):
        out = F.concat_ws(how[4:-1], *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    else:
        raise ValueError(f"unknown format {how!r}")
    return df.select(out.alias("value"))


class Handlers:
    """Opens a URI with the first handler that supports it."""

    def __init__(self, *handlers):
        self.handlers = handlers

    def open(self, uri: str) -> object:
        for supports, opens in self.handlers:
            if supports(uri):
                return opens(uri)
        raise ValueError(f"no handler for {uri}")
