"""Sharding by a K-d tree (operator 3), DataFrame functions only.

Documents are points in dimensions of their metadata: size, language, source and id. A cell that needs more than one
shard is split along its widest dimension (its range against the range of all documents) at the weighted quantile that
gives each side its part of the bytes: the weighted median, or the nearest to it that whole leaves allow. All cells of a level are
split at once. A quantile comes from a histogram of ``BINS`` bins; ties are split by a hash of text, id and where the row was read, in a
second histogram over the bin where the quantile lies, so that neither a hot value nor a row repeated many times has to fall on one side. Law: bytes.

Only histograms, at most ``BINS`` bins for each cell, are ever gathered, and they are reduced to a row for each cell before they reach the
driver. A document's shard is one expression over its metadata: texts are read once and not shuffled.

Null text: size 16. Null metadata: the dimension's smallest value. An id that is no number is placed by its CRC. Equal rows may part, so which of them goes where depends on how the files are
dealt to tasks; the rest doesn't, but for ties at a cut. An empty table gives an empty result. Very long texts: only their size and CRC are taken; a shard is over its part by at most
the rows of one bin of ties. Only the named columns are read and returned, so others can't clash. The splits run when the plan is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

BINS = 1024
#: Slots are counted within so many parts of a shard.
SLOT_PARTS = 64
OVERHEAD = 16


def points(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, size, text_crc32, d0, d1, ...: dimensions as doubles, tie: 0 <= double < 1)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    named = [F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")).cast("double"), F.lit(0.0)) for c in categories]
    place = [F.log(size.cast("double")), *named, F.coalesce(F.col(id_col).try_cast("double"), F.crc32(F.col(id_col).cast("string").cast("binary")).cast("double"), F.lit(0.0))]
    crc = F.crc32(text.cast("binary"))
    tie = (F.pmod(F.xxhash64(crc, size, F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("tie")
    return df.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), *[p.alias(f"d{i}") for i, p in enumerate(place)], tie)


def split(cloud: DataFrame, n_shards: int) -> tuple[DataFrame, Column]:
    """The points with their cell, and the shard of a cell as an expression. ``cloud`` is computed already and is read a few times for each level."""
    dims = [c for c in cloud.columns if c[0] == "d" and c[1:].isdigit()]
    node: Column = F.lit(0)
    leaves = {0: (0, n_shards)}  # node -> its shards
    ranges = [x for d in dims for x in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]
    all_of = cloud.agg(*ranges).first()
    while any(b - a > 1 for a, b in leaves.values()):
        level = cloud.withColumn("node", node)
        boxes = {r["node"]: r for r in level.groupBy("node").agg(*ranges).collect()}  # a row for each cell
        plan = {}
        for k, (a, b) in leaves.items():
            if b - a > 1:
                box = boxes.get(k)
                wide = lambda d, box=box: (box[f"hi_{d}"] - box[f"lo_{d}"]) / ((all_of[f"hi_{d}"] - all_of[f"lo_{d}"]) or 1.0) if box else 0.0
                d = max(dims, key=wide)
                plan[k] = (d, box[f"lo_{d}"] if box else 0.0, box[f"hi_{d}"] if box else 0.0, (b - a) // 2 / (b - a))
        value = _case({k: F.col(p[0]) for k, p in plan.items()})
        low, high = (_case({k: F.lit(float(p[i])) for k, p in plan.items()}) for i in (1, 2))
        part = _case({k: F.lit(p[3]) for k, p in plan.items()})
        step = F.when(high > low, F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
        rows = level.where(F.col("node").isin(list(plan))).select("node", "size", "tie", step.alias("bin"), part.alias("part"))
        first = {r["node"]: r for r in _quantile(rows, None).collect()}  # a row for each cell
        at = _case({k: F.lit(r["bin"]) for k, r in first.items()}) if first else F.lit(None)
        rest = _case({k: F.lit(float(r["left"])) for k, r in first.items()}) if first else F.lit(None)
        fine = rows.where(F.col("bin") == at).select("node", "size", F.floor(F.col("tie") * BINS).cast("int").alias("bin"), rest.alias("part"))
        second = {r["node"]: r for r in _quantile(fine, "part").collect()}  # a row for each cell
        sides, after = {}, {}
        for k, (a, b) in leaves.items():
            if k in plan:
                middle = a + (b - a) // 2
                after |= {2 * k + 1: (a, middle), 2 * k + 2: (middle, b)}
                d, lo, hi, _ = plan[k]
                bin_at, tie_at = (first[k]["bin"], second[k]["bin"]) if k in second else (0, 0)
                own = F.when(F.lit(hi) > F.lit(lo), F.least(F.floor((F.col(d) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * BINS), F.lit(BINS - 1))).otherwise(0)
                before = (own < bin_at) | ((own == bin_at) & (F.floor(F.col("tie") * BINS) <= tie_at))
                sides[k] = F.when(before, F.lit(2 * k + 1)).otherwise(F.lit(2 * k + 2))
            else:
                after[k], sides[k] = (a, b), F.lit(k)
        leaves = after
        cloud = cut(level.withColumn("node", _case(sides, "node")))
        node = F.col("node")
    if len(leaves) == 1:
        cloud = cloud.withColumn("node", node)
    return cloud, _case({k: F.lit(a) for k, (a, _) in leaves.items()}, "node")


def _case(of: dict[int, Column], node: str = "node") -> Column:
    out = None
    for k, v in of.items():
        out = F.when(F.col(node) == k, v) if out is None else out.when(F.col(node) == k, v)
    return out if out is not None else F.lit(None)


def _quantile(rows: DataFrame, target: str | None) -> DataFrame:
    """For each node the bin where the running bytes pass its part of all bytes (or the bytes of ``target``), and how many bytes of that bin belong before the cut."""
    bins = rows.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.max("part").alias("part"))
    run = bins.select("node", "bin", "w", "part", F.sum("w").over(Window.partitionBy("node").orderBy("bin")).alias("upto"), F.sum("w").over(Window.partitionBy("node")).alias("all"))
    goal = F.col("part") if target else F.col("part") * F.col("all")
    if target:  # the cut nearest to the goal
        return run.groupBy("node").agg(F.min_by("bin", F.abs(F.col("upto") - goal)).alias("bin"), F.lit(0.0).alias("left"))
    return run.where(F.col("upto") >= goal - 0.5).groupBy("node").agg(F.min_by("bin", "bin").alias("bin"), F.min_by(goal - (F.col("upto") - F.col("w")), "bin").alias("left"))


def shards(df: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(``id_col``, size, text_crc32, shard int, slot long). The leaves: ``n_shards``, or as many as ``target_bytes`` asks for."""
    cloud = cut(points(df, id_col, text_col, categories))
    if n_shards is None:
        total = cloud.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, math.ceil(total / target_bytes))
    cloud, shard = split(cloud, n_shards)
    placed = cloud.select("id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.hash("tie"), F.lit(SLOT_PARTS)).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    counts = counts.select("shard", "part", before.alias("before"))  # SLOT_PARTS rows for each shard
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "size", "text_crc32"))
    slots = placed.withColumn("k", within).join(counts, ["shard", "part"])
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("k") - 1 + F.col("before")).cast("long").alias("slot"))
