"""Near copies by word shingles (the pipeline's near-dedup stage): two texts are linked if the Jaccard similarity of their shingle sets reaches a bound.

Texts with equal sets are one node first. Candidates are found by operator 8's method: a SimHash fingerprint of each set, tiles of fingerprints, and every pair of tiles
compared whole by exclusive or and bit counts, which leaves a spanning forest. The fingerprint is operator 8's (here of the distinct shingles) and three more words made alike, as 64 bits don't part
a similarity of 0.8 from chance: of 256 bits a pair at 0.8 differs in 39 on average, in 48 at worst (four of five shingles), and unlike sets in 128. Within ``RADIUS`` are all pairs at 0.8 but 2 in a million
at that worst and 4 in a billion of others, and 2 in ten billion unlike ones. Tiles are dealt by size; sets whose sizes alone rule the bound out aren't compared. Components of candidates are then
decided exactly: a component is dealt into tiles of at most about ``TILE`` sets and ``TILE_SHINGLES`` shingles, and each pair of tiles is one group, in which pairs of sets are compared until every pair is
either compared or already connected. A pair of tiles returns links that span its classes, at most one for each set; their components are the classes.

Words are as in ``simhash.fingerprint``; fewer words than a shingle are one shingle. Null and wordless texts have the empty set, and are one node.
The comparison of fingerprints of like sizes, and that of one component's different sets, grow with their square; tiles bound a task's memory, not the square. Repeated rows share a node; null ids pass through;
an empty table gives an empty result. Very long texts are read whole; one alone may exceed a tile. Only the named columns are returned, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, released, small_batches
from quillspark.llm.simhash import components, spanning, tile_pairs

#: 64-bit words of a fingerprint, and the bits in which candidates may differ at a similarity of 0.8.
WORDS = 4
RADIUS = 78
#: Different sets in a tile of fingerprints, about.
FP_TILE = 4096
#: Different sets, and shingles in them, of a tile of one component, about.
TILE = 1024
TILE_SHINGLES = 4_000_000


def shingles(text: str | None, size: int):
    """Sorted distinct XXH64 of the shingles of ASCII-lower-cased words."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64))


def fingerprint(hashes):
    """``WORDS`` SimHash words of a set of hashes: a bit is 1 if it is set in over half of them. The first word takes the hashes as they are, as operator 8 does, the others mix them anew."""
    import numpy as np

    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    ones = np.zeros((WORDS, 64), np.int64)
    for i in range(0, len(hashes), 255):
        x = hashes[i : i + 255] + np.arange(1, WORDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x = np.vstack([hashes[None, i : i + 255], x ^ x >> np.uint64(31)]).astype("<u8")
        bits = np.unpackbits(x.view(np.uint8).reshape(WORDS, -1, 8), axis=2, bitorder="little")
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def close_sets(a, b, same: bool, similarity: float, radius: int):
    """Positions of pairs (i in a, j in b) of different sets whose fingerprints are within the radius and whose sizes allow the similarity, block by block, only i < j if both are the same tile. a, b: sizes, ascending, and a row of fingerprints for each word."""
    import numpy as np

    (m, x_words), (n, y_words) = a, b
    for i in range(0, len(m), 64):
        low, high = np.searchsorted(n, [similarity * m[i] * (1 - 1e-9), m[i : i + 64][-1] / similarity * (1 + 1e-9)])
        for j in range(max(i, low) if same else low, high, 4096):
            to = min(j + 4096, high)
            apart = np.zeros((len(m[i : i + 64]), to - j), np.int16)
            for x, y in zip(x_words, y_words):
                apart += np.bitwise_count(x[i : i + 64, None] ^ y[None, j:to])
            x, y = np.nonzero(apart <= radius)
            x, y = x + i, y + j
            # the most that two different sets of such sizes can share
            most = np.minimum(m[x], n[y]) - (m[x] == n[y])
            fits = most >= similarity * (m[x] + n[y] - most) * (1 - 1e-9)
            if same:
                fits &= x < y
            if fits.any():
                yield x[fits], y[fits]


def candidates(nodes: DataFrame, similarity: float, radius: int, tile: int = FP_TILE) -> DataFrame:
    """(a, b): links between ``nodes`` (node, size, fp: array of ``WORDS`` longs) that span the components of all candidates."""
    import math

    step = -math.log(similarity)
    top = int(math.log(2**31) / step) + 2
    value = F.struct("node", "size", *[F.col("fp")[k].alias(f"w{k}") for k in range(WORDS)])
    # sizes that allow the similarity are at most one class apart; classes are wider by a hair, for logarithms are rounded
    pairs = tile_pairs(nodes.where("size > 0"), value, F.floor(F.log("size") / (step * (1 + 1e-9))), top, 1, tile)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def opened(sets):
            node, size, *words = (x.to_numpy(zero_copy_only=False) for x in sets.values.flatten())
            order = np.argsort(size, kind="stable")
            return node[order], (size[order].astype(np.int64), [w[order].view(np.uint64) for w in words])

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                same = not y.is_valid
                a_nodes, a = opened(x)
                b_nodes, b = (a_nodes, a) if same else opened(y)
                links = np.array(spanning(close_sets(a, b, same, similarity, radius), len(a_nodes), len(b_nodes), same), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(a_nodes[links[:, 0]]), pa.array(b_nodes[links[:, 1]])], names=["a", "b"])
        released()

    return pairs.mapInArrow(run, "a long, b long")


def marks(df: DataFrame, text_col: str, size: int, keep: list[str]) -> DataFrame:
    """(``keep``, node long: hash of the shingle set, size int: its shingles, fp: array<long>, its fingerprint) for each row."""
    small_batches(df.sparkSession)
    kept = df.select(*keep)
    n = len(keep)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            sets = [shingles(x.as_py(), size) for x in b.column(n)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            fps = [fingerprint(s).view(np.int64) for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(nodes), sizes, pa.array(fps, pa.list_(pa.int64()))], names=[*b.schema.names[:n], "node", "size", "fp"])
        released()

    schema = T.StructType([*kept.schema.fields, T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.ArrayType(T.LongType()))])
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def joined(sets: list, similarity: float, tiles: list[int]) -> list[tuple[int, int]]:
    """Pairs of sets that span the classes of all pairs whose Jaccard similarity reaches ``similarity``. If there are two tiles, only pairs across them count."""
    import numpy as np

    root = list(range(len(sets)))
    across = len(set(tiles)) > 1
    kept = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    for p, i in enumerate(order):
        for j in order[p + 1 :]:
            a, b = len(sets[i]), len(sets[j])
            if a < similarity * b:
                break
            if across and tiles[i] == tiles[j]:
                continue
            x, y = find(i), find(j)
            if x != y:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (a + b - both):
                    root[max(x, y)] = min(x, y)
                    kept.append((i, j))
    return kept


def classes(df: DataFrame, id_cols: list[str], keep: list[str], text_col: str = "text", size: int = 5, similarity: float = 0.8, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """(``id_cols``, ``keep`` columns, class long) for each row; ``id_cols`` tell different rows apart and are never null. Another ``similarity`` needs another ``radius``."""
    marked = cut(marks(df, text_col, size, [*id_cols, *keep]))
    nodes = cut(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min(F.struct(*id_cols)).alias("one")))
    links = candidates(nodes, similarity, radius)
    found = nodes.join(components(links), "node")
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum(F.col("size").cast("long")) / TILE_SHINGLES)).cast("int")
    large = found.groupBy("root").agg(tiles.alias("tiles")).where("tiles > 1")
    asked = found.join(large, "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    asked = asked.select(*[F.col(f"one.{c}").alias(c) for c in id_cols], "node", "root", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    texts = df.select(*id_cols, F.col(text_col).alias("_text")).dropDuplicates(id_cols).join(asked, id_cols).select("root", "node", "tile", "_text", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    texts = texts.select("root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "tile", "_text")

    def decide(group):
        import numpy as np
        import pyarrow as pa

        nodes = group.column("node").to_numpy()
        pairs = joined([shingles(x.as_py(), size) for x in group.column("_text")], similarity, group.column("tile").to_pylist())
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    same = components(texts.groupBy("root", "low", "high").applyInArrow(decide, "a long, b long")).select("node", F.col("root").alias("class"))
    return marked.join(same, "node", "left").select(*id_cols, *keep, F.coalesce("class", "node").alias("class"))
