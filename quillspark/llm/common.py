"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import cut  # noqa: F401

#: Rows of whole documents in one Arrow batch: bounds the memory of a Python worker.
BATCH_ROWS = 1000
#: Bytes in one, which bounds it where texts are long.
BATCH_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole documents are long, so Arrow batches hold few of them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released() -> None:
    """Gives memory that a Python worker no longer needs back to the system: idle workers stay beside those of later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, *without: str) -> Column:
    """All columns of ``df`` as one, ``row``, so that an operator's own names can't clash with them."""
    return F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in without]).alias("row")


def unpacked(rows: DataFrame, df: DataFrame, out: Column, out_col: str, replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``df`` out of ``row`` (or as ``replaced`` says), and ``out_col``, which takes the place of a column of that name."""
    replaced = replaced or {}
    kept = [replaced.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(df.columns) if c.lower() != out_col.lower()]
    return rows.select(*kept, out.alias(out_col))


def words(text: Column) -> Column:
    """Words between the ASCII white space of the contracts: space and U+0009 to U+000D. Null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda that names an expression would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
