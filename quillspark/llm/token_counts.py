"""Token counts by an exact length histogram (operator 6).

Documents are aggregated by encoded length; suffix sums over the histogram answer totals, quantiles and truncated totals for every
context limit, so no question needs the documents again. The histogram has a row for each length that occurs. Its suffix sums
come from blocks of 1024 lengths: sums of blocks, then sums within a block, so no task holds the whole histogram.

Null text: empty, length 0. Repeated rows count each time. An empty table has an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

BLOCK = 1024


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) for each length that occurs."""
    return lengths.groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """A row for each occurring length L: n_docs, docs_at_least (length >= L), tokens_at_least (their tokens), docs_up_to and tokens_up_to (length <= L), total_docs, total_tokens, truncated_tokens (all documents cut to L) and cut_tokens (what that loses)."""
    histogram = cut(histogram)  # read twice below; the encoding behind it runs once
    rows = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    down = Window.orderBy(F.col("block").desc())
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    blocks = blocks.select(
        "block",
        (F.sum("d").over(down) - F.col("d")).alias("docs_above"),
        (F.sum("t").over(down) - F.col("t")).alias("tokens_above"),
        F.sum("d").over(Window.partitionBy(F.lit(0))).alias("total_docs"),
        F.sum("t").over(Window.partitionBy(F.lit(0))).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    rows = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(within) + F.col("tokens_above")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    up_to = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_docs") * F.col("n_tokens")
    longer = F.col("docs_at_least") - F.col("n_docs")
    truncated = up_to + longer * F.col("n_tokens")
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_docs") - longer).alias("docs_up_to"),
        up_to.alias("tokens_up_to"),
        "total_docs",
        "total_tokens",
        truncated.alias("truncated_tokens"),
        (F.col("total_tokens") - truncated).alias("cut_tokens"),
    )


def for_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_tokens) for any limits, whether or not a document has that length."""
    at = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    longer = F.col("n_tokens") > F.col("context_limit")
    return (
        sums.select(at, "n_tokens", "n_docs")
        .groupBy("context_limit")
        .agg(
            F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
            F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
        )
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return sums.select(at, "n_tokens", "docs_up_to", "total_docs").where("docs_up_to >= share * total_docs").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
