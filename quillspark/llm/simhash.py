"""SimHash near-duplicates (operator 8): tiled exact comparison of all fingerprints.

Fingerprints are made distinct first, so a group of equal texts is one fingerprint. The distinct ones are cut into tiles by their
population count and, where a count has many, by a hash. Two tiles whose population counts differ by more than the radius can't
hold a link and are skipped; every other pair of tiles is compared whole with numpy's exclusive or and bit counts. A pair of tiles
returns a spanning forest of its links, not the links: as many rows as fingerprints at most, with the same components. Rounds of
large-star and small-star then join the forests. Nothing about documents or links goes to the driver, only a count for each of
the 65 population counts.

The comparison is exact and so grows with the square of the distinct fingerprints; XOR and bit counts keep the constant near a
nanosecond a pair.

Null and wordless texts have fingerprint 0, which links like any other. Null ids: the rows stay, and a component's id is its smallest
id that isn't null (null if there is none). Repeated rows each come back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, shuffle_partitions, small_batches

#: Fingerprints in a tile, about.
TILE = 16_384


def fingerprint(text: str | None, shingle: int) -> int:
    """ASCII-lower-cased words, their shingles (fewer words: one shingle of all), XXH64 with seed 42, and for each bit the majority."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """(``id_col``, any ``keep`` columns, fp long): one row for each row of ``df``."""
    small_batches(df.sparkSession)
    kept = df.select(id_col, *(keep or []))
    n = len(kept.columns)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in b.column(n)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(values)], names=[*b.schema.names[:n], "fp"])

    from pyspark.sql import types as T

    return df.select(*kept.columns, F.col(text_col).alias("_text")).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("fp", T.LongType())]))


def close_pairs(a, b, radius: int, same: bool):
    """Positions of pairs (i in a, j in b) within the radius, block by block, only i < j if both are the same tile."""
    import numpy as np

    for i in range(0, len(a), 64):
        for j in range(i if same else 0, len(b), 4096):
            x, y = np.nonzero(np.bitwise_count(a[i : i + 64, None] ^ b[None, j : j + 4096]) <= radius)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def forest(a, b, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links that span the components of all links between two tiles (or within one)."""
    return spanning(close_pairs(a, b, radius, same), len(a), len(b), same)


def spanning(pairs, n_a: int, n_b: int, same: bool) -> list[tuple[int, int]]:
    """Of ``pairs`` (blocks of positions in two tiles, or twice in one) those that span their components."""
    import numpy as np

    shift = 0 if same else n_a
    root = np.arange(shift + n_b)
    kept = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, y in pairs:
        y = y + shift
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                kept.append((i, j - shift))
    return kept


def tile_pairs(nodes: DataFrame, value: Column, key: Column, top: int, reach: int, tile: int) -> DataFrame:
    """(a, b): the ``value`` of all ``nodes`` in each pair of tiles whose keys (0 to ``top``) differ by ``reach`` at most; b is null where a tile meets itself."""
    spark = nodes.sparkSession
    keyed = nodes.select(value.alias("fp"), key.cast("int").alias("pop"))
    counts = {r["pop"]: r["n"] for r in keyed.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each key at most
    parts = F.element_at(F.array(*[F.lit(-(-counts.get(p, 0) // tile) or 1) for p in range(top + 1)]), F.col("pop") + 1)
    keyed = keyed.withColumn("sub", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    tiles = keyed.groupBy("pop", "sub").agg(F.collect_list("fp").alias("fps")).select(F.struct("pop", "sub").alias("tile"), "fps")  # a tile has a bounded size
    # pairs of tiles meet as ids; the fingerprints come to them one tile at a time
    ids = keyed.select("pop", "sub").distinct().select("pop", F.struct("pop", "sub").alias("tile"))
    left = ids.select(F.col("tile").alias("ta"), F.explode(F.sequence("pop", F.col("pop") + reach)).alias("at"))
    pairs = left.join(ids.select(F.col("pop").alias("at"), F.col("tile").alias("tb")), "at").where("ta <= tb").select("ta", "tb")
    pairs = pairs.join(tiles.select(F.col("tile").alias("ta"), F.col("fps").alias("a")), "ta").join(tiles.select(F.col("tile").alias("tb"), F.col("fps").alias("b")), "tb")
    pairs = pairs.select("a", F.when(F.col("ta") != F.col("tb"), F.col("b")).alias("b"))
    return pairs.repartition(max(64, shuffle_partitions(spark)))


def forests(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): links between fingerprints of ``nodes`` (fp distinct) that span the components of all links within the radius."""
    pairs = tile_pairs(nodes, F.col("fp"), F.bit_count("fp"), 64, radius, tile)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a = np.sort(x.values.to_numpy(zero_copy_only=False).astype(np.int64))
                same = not y.is_valid
                b = a if same else np.sort(y.values.to_numpy(zero_copy_only=False).astype(np.int64))
                links = np.array(forest(a.view(np.uint64), b.view(np.uint64), radius, same), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(a[links[:, 0]]), pa.array(b[links[:, 1]])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b), the smallest node that it reaches. Alternating large and small stars; each round is cut."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, keep: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """(``id_col``, any ``keep`` columns, fp long, class long: the smallest fingerprint reachable, component_id: the smallest id reachable)."""
    marked = cut(fingerprints(df, id_col, text_col, shingle, keep))
    nodes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = components(forests(nodes, radius, tile))
    classes = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("class"), "least")
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = classes.select("fp", "class").join(least, "class")
    return marked.join(classes, "fp").select(id_col, *(keep or []), "fp", "class", "component_id")
