"""Suffix-array dedup (operator 5): every byte covered by a string of 200 bytes that also starts elsewhere is removed.

Equal texts are one text first; a text with copies is removed whole. Over the distinct texts:

1. Anchors. In every window of 200 bytes the 48-byte strings of least hash are anchors, so two equal windows hold the same anchor at
   the same place. Anchors whose hash occurs once can't lie in a repeated window and leave here. Places of a hot anchor don't meet in one task for that.
2. Runs. Each task sorts the suffixes that start at its remaining anchors (200 bytes, with the 152 bytes before as payload),
   front-codes them against their predecessor and sends one run for each bucket of hashes, in chunks. Equal neighbours cost no bytes.
3. Merge. Spark sorts a partition's chunks by their first suffix, and spills if need be; the chunks that overlap meet in loser trees that keep for each contestant the
   length of its prefix shared with the last winner: unequal lengths decide without a look at the strings, equal ones are compared from there on.
   The sorted suffixes stream out with their common prefixes (LCP), so a partition may be larger than the memory of its task; a group of step 4 may not.
4. Windows. Suffixes with a common prefix of an anchor's length form a group. A window that starts ``o`` bytes before the anchor repeats if another
   member shares ``o`` bytes to the left and ``200 - o`` to the right. The LCP array gives classes for the right, the sorted
   left sides those for the left; no pairs of a large group are listed.
5. The spans found go back to their texts, which lose them.

Texts are shuffled once, by their hash. Everything is decided on the bytes; hashes only choose candidates.

Null text: empty. Texts under 200 bytes lose nothing. Repeated rows are copies of each other. Null ids pass through.
The bytes are summed when the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import shuffle_partitions, small_batches

LENGTH = 200
ANCHOR = 48
#: Bytes hashed at once.
CHUNK = 1 << 19
#: Suffixes in a task's runs before they are sent.
RUN = 60_000
#: An anchor that occurs more often than this is broadcast as hot; in a corpus of more than HOT * HOT_ANCHORS bytes, one that occurs more often than once in HOT_ANCHORS bytes.
#: Anchors are fewer than bytes, so at most HOT_ANCHORS are hot, whatever the corpus.
HOT = 10_000
HOT_ANCHORS = 1 << 20
#: Suffixes in a chunk of a run, the unit that a merge opens.
ENTRIES = 256
#: Chunks that a merge opens at once, at least.
OPENED = 16


def _mixed(seed: int, n: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _slide(x, size: int, least):
    """The least (or most) of every ``size`` neighbours, by doubling."""
    have = 1
    while have * 2 <= size:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


class Anchors:
    """Chosen anchors of texts. What is chosen in a window depends on the window's bytes alone (more may be chosen besides)."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        import numpy as np

        self.length, self.anchor, self.window = length, anchor, length - anchor + 1
        self.values = _mixed(5, 256)
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        import numpy as np

        if len(self.power) < n:
            with np.errstate(over="ignore"):
                inverse = pow(self.FACTOR, -1, 1 << 64)
                self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, self.FACTOR, np.uint64)]))
                self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]))

    def of(self, texts: list[bytes]):
        """(hash, text, position) arrays."""
        import numpy as np

        out, group, held = [], [], 0
        for i, t in enumerate(texts):
            if len(t) >= self.length:
                group.append(i)
                held += len(t)
            if group and (held >= CHUNK or i == len(texts) - 1):
                out.append(self._chunk(texts, group))
                group, held = [], 0
        if group:
            out.append(self._chunk(texts, group))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3

    def _chunk(self, texts: list[bytes], group: list[int]):
        import numpy as np

        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        sizes = np.array([len(texts[i]) for i in group])
        self._powers(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.power[: len(data)], dtype=np.uint64)])
        h = (total[self.anchor :] - total[: -self.anchor]) * self.inverse[: len(data) - self.anchor + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = _slide(h, self.window, np.minimum)
        around = np.zeros(len(h) + self.window - 1, np.uint64)
        around[self.window - 1 : self.window - 1 + len(least)] = least
        at = np.flatnonzero(_slide(around, self.window, np.maximum) == h)
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, at, side="right")
        inside = at + self.anchor <= ends[text]
        at, text = at[inside], text[inside]
        return h[at].view(np.int64), np.array(group)[text], at - (ends - sizes)[text]


def shared_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``at``."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while a[at : at + 16] == b[at : at + 16]:
        at += 16
    while a[at] == b[at]:
        at += 1
    return at


def front_code(entries: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """Sorted (suffix, reversed left side, payload of a fixed size) as one binary run: shared length, rest length, left length (255: as before), then the bytes."""
    out, before, left_before = [], b"", None
    for suffix, left, payload in entries:
        lcp = shared_prefix(before, suffix) if before else 0
        if left == left_before and suffix == before:
            out.append(bytes((lcp, 0, 255)) + payload)
        else:
            out.append(bytes((lcp, len(suffix) - lcp, len(left))) + suffix[lcp:] + left + payload)
        before, left_before = suffix, left
    return b"".join(out)


def front_decode(run: bytes, payload: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(shared length with the one before, suffix, reversed left side, payload) of each entry, in order."""
    at, suffix, left, n = 0, b"", b"", len(run)
    while at < n:
        lcp, rest, size = run[at], run[at + 1], run[at + 2]
        at += 3
        suffix = suffix[:lcp] + run[at : at + rest] if rest or lcp != len(suffix) else suffix
        at += rest
        if size != 255:
            left = run[at : at + size]
            at += size
        yield lcp, suffix, left, run[at : at + payload]
        at += payload


def merge(chunks: Iterable[bytes], payload: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """All entries of sorted front-coded chunks in order, each with its common prefix with the one before: loser trees over common prefixes.

    The chunks come in the order of their first suffixes and are opened as they are needed: a tree plays until the chunk opened last would win, then the next
    tree takes over what is left of its contestants, with the prefixes known. Only chunks that overlap are held.
    """
    waiting = (front_decode(c, payload) for c in chunks)
    open_: list[tuple] = []  # (common prefix of its head with the last winner, head, rest)
    last, more = b"", True
    while more or open_:
        for _ in range(max(OPENED, len(open_))):  # what a new tree costs is paid by as many new chunks
            rest = next(waiting, None)
            if rest is None:
                more = False
                break
            head = next(rest)
            open_.append((shared_prefix(last, head[1]), head, rest))
        if not open_:
            return
        gate = len(open_) - 1 if more else -1  # no chunk still to come starts before this one
        k = 1
        while k < len(open_):
            k *= 2
        heads: list[tuple | None] = [x[1] for x in open_] + [None] * (k - len(open_))
        sources = [x[2] for x in open_]
        known = [x[0] for x in open_] + [0] * (k - len(open_))  # common prefix of each head with the last winner, of a loser with the winner of its match
        losers = [-1] * k

        def play(a: int, b: int, heads=heads, known=known) -> tuple[int, int]:
            """(winner, loser) of two heads; the loser's known prefix becomes the one with the winner."""
            x, y = heads[a], heads[b]
            if x is None or y is None:
                return (a, b) if y is None else (b, a)
            p, q = known[a], known[b]
            if p != q:
                return (a, b) if p > q else (b, a)
            s, t = x[1], y[1]
            n = shared_prefix(s, t, p)
            if n == len(s) or (n < len(t) and s[n] < t[n]):
                known[b] = n
                return a, b
            known[a] = n
            return b, a

        winners = [0] * (2 * k)
        winners[k:] = range(k)
        for node in range(k - 1, 0, -1):
            winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
        top = winners[1] if k > 1 else 0
        while heads[top] is not None and top != gate:
            head = heads[top]
            last = head[1]
            yield known[top], last, head[2], head[3]
            heads[top] = following = next(sources[top], None)
            known[top] = following[0] if following else 0
            node = (top + k) // 2
            while node:
                top, losers[node] = play(top, losers[node])
                node //= 2
        # sorted strings share with the last winner the least of what neighbours on the way down share
        open_, below = [], [(1, top, known[top])]
        while below:
            node, winner, shared = below.pop()
            if heads[winner] is None:
                continue
            if node >= k:
                open_.append((shared, heads[winner], sources[winner]))
                continue
            child = winner + k
            while child // 2 != node:
                child //= 2
            below += [(child, winner, shared), (child ^ 1, losers[node], min(shared, known[losers[node]]))]


def _left_order(lefts: list[bytes]):
    """(order, common prefix with the one before) of the reversed left sides."""
    order = sorted(range(len(lefts)), key=lefts.__getitem__)
    lcp = [0] + [shared_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:])]
    return order, lcp


def repeated(lcps: list[int], suffixes: list[bytes], lefts: list[bytes], length: int, anchor: int) -> list[tuple[int, int] | None]:
    """For each member of a group (sorted suffixes, their common prefixes): the least and the most ``o`` for which its window that starts ``o`` bytes before repeats."""
    m, reach = len(suffixes), length - anchor
    found: list[tuple[int, int] | None] = [None] * m
    if m <= 6:
        low, high = [length] * m, [-1] * m
        for i in range(m):
            right = length
            for j in range(i + 1, m):
                right = min(right, lcps[j])
                left = shared_prefix(lefts[i], lefts[j])
                if left + right >= length:
                    a, b = max(0, length - right), min(left, reach)
                    for x in (i, j):
                        low[x], high[x] = min(low[x], a), max(high[x], b)
        return [(a, b) if b >= a else None for a, b in zip(low, high)]
    import numpy as np

    right_lcp = np.array(lcps)
    right_lcp[0] = 0
    order, left_lcp = _left_order(lefts)
    order, left_lcp = np.array(order), np.array(left_lcp)
    right_size, left_size = np.array([len(s) for s in suffixes]), np.array([len(x) for x in lefts])
    low, high = np.full(m, length), np.full(m, -1)
    marks = np.unique(np.concatenate([left_lcp, left_lcp + 1, left_size + 1, length - right_lcp, length - right_lcp + 1, length - right_size, [0, reach]]))
    marks = [*marks[(marks >= 0) & (marks <= reach)].tolist(), reach + 1]  # between two marks no class changes
    left_class = np.zeros(m, np.int64)
    for o, after in zip(marks, marks[1:]):
        fits = (left_size >= o) & (right_size >= length - o)
        right_class = np.cumsum(right_lcp < length - o)
        left_class[order] = np.cumsum(left_lcp < o)
        key = np.where(fits, right_class * (m + 1) + left_class, -1 - np.arange(m))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = count[back] > 1
        low[hit], high[hit] = np.minimum(low[hit], o), np.maximum(high[hit], after - 1)
    return [(a, b) if b >= a else None for a, b in zip(low.tolist(), high.tolist())]


def repeated_spans(chunks: Iterable[bytes], length: int, anchor: int, payload: int) -> Iterator[tuple[bytes, int, int]]:
    """(payload, bytes before the anchor, bytes from it) that repeat, for each suffix of the chunks (as ``merge`` takes them) with any."""

    def close(group: list) -> Iterator[tuple[bytes, int, int]]:
        if len(group) < 2 and len(group[0][3]) < 2:
            return
        # members with the same sides are one class and repeat as far as their sides go
        found = repeated([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], length, anchor) if len(group) > 1 else [None]
        for (_, suffix, left, owners), f in zip(group, found):
            if len(owners) > 1 and len(left) + len(suffix) >= length:
                a, b = max(0, length - len(suffix)), min(len(left), length - anchor)
                f = (min(a, f[0]), max(b, f[1])) if f else (a, b)
            if f:
                for p in owners:
                    yield p, f[1], length - f[0]

    group: list = []
    places: dict[bytes, int] = {}
    for lcp, suffix, left, p in merge(chunks, payload):
        if group and lcp < anchor:
            yield from close(group)
            group, places = [], {}
        if group and suffix == group[-1][1]:
            k = places.get(left)
            if k is not None:
                group[k][3].append(p)
                continue
        else:
            places = {}
        places[left] = len(group)
        group.append((lcp, suffix, left, [p]))
    if group:
        yield from close(group)


def text_keys(text: Column) -> list[Column]:
    """96 bits of hash that stand for a whole text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, text, copies): each different text once."""
    rows = df.select(*text_keys(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def repeats(texts: DataFrame, hot: int, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, start, end): byte spans of repeated windows of distinct texts; their union is what repeats. Anchors that occur more than ``hot`` times are broadcast."""
    spark = texts.sparkSession
    small_batches(spark)

    def anchors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chosen = Anchors(length, anchor)
        for b in batches:
            h, text, at = chosen.of([x.encode("utf-8", "surrogatepass") for x in b.column(2).to_pylist()])
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(rows), b.column(1).take(rows), pa.array(at.astype("int32"))], names=["h", "k1", "k2", "at"])

    # all columns of the texts here and below: one exchange then serves every use
    found = texts.select("k1", "k2", "text", "copies").mapInArrow(anchors, "h long, k1 long, k2 int, at int")
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # what occurs often is known to be shared without meeting its count, so its places stay spread
    often = counts.where(F.col("n") > hot).select("h", F.lit(True).alias("often"))
    spread = F.when(F.col("often"), F.xxhash64("h", "k1", "k2", "at")).otherwise(F.col("h"))
    met = found.join(F.broadcast(often), "h", "left").withColumn("meets", spread)
    met = met.join(counts.select(F.col("h").alias("meets"), F.lit(True).alias("shared")), "meets", "left").where("often or shared")
    places = met.groupBy("k1", "k2").agg(F.collect_list("at").alias("places"), F.collect_list("h").alias("hashes"))
    buckets = shuffle_partitions(spark)
    payload = 16

    def runs(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa

        held: list[list] = [[] for _ in range(buckets)]
        n = 0

        def send() -> pa.RecordBatch:
            rows = [(k, x[i][0], front_code(x[i : i + ENTRIES])) for k, x in enumerate(map(sorted, held)) for i in range(0, len(x), ENTRIES)]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "first", "chunk"])

        for b in batches:
            for k1, k2, text, places, hashes in zip(*(c.to_pylist() for c in b.columns[:5])):
                text = text.encode("utf-8", "surrogatepass")
                for at, h in zip(places, hashes):
                    left = text[max(0, at - (length - anchor)) : at][::-1]
                    held[h % buckets].append((text[at : at + length], left, struct.pack("<qii", k1, k2, at)))
                n += len(places)
                if n >= RUN:
                    yield send()
                    held, n = [[] for _ in range(buckets)], 0
        if n:
            yield send()

    sent = texts.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places", "hashes", "copies").mapInArrow(runs, "bucket int, first binary, chunk binary")

    def merged(batches: Iterator) -> Iterator:
        import itertools
        import struct

        import pyarrow as pa
        import pyarrow.compute as pc

        chunks = (x.as_py() for b in batches for x in b.column(0))
        found = repeated_spans(chunks, length, anchor, payload)
        while rows := [(*struct.unpack("<qii", p), before, beyond) for p, before, beyond in itertools.islice(found, RUN)]:
            k1, k2, at, before, beyond = (pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.int32()] * 4)))
            yield pa.RecordBatch.from_arrays([k1, k2, pc.subtract(at, before), pc.add(at, beyond)], names=["k1", "k2", "start", "end"])

    return sent.repartition("bucket").sortWithinPartitions("first").select("chunk").mapInArrow(merged, "k1 long, k2 int, start int, end int")


def deduplicated(df: DataFrame, text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """For each different text: (k1, k2 as of ``text_keys``, n_bytes, spans: maximal removed byte runs, kept binary)."""
    texts = distinct_texts(df, text_col)
    n_bytes = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    hot = max(HOT, n_bytes // HOT_ANCHORS)
    spans = repeats(texts, hot, length, anchor).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def remove(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            sizes, spans, kept = [], [], []
            for text, copies, found in zip(*(c.to_pylist() for c in b.columns[2:])):
                text = text.encode("utf-8", "surrogatepass")
                own: list[list[int]] = []
                if copies > 1 and len(text) >= length:
                    own = [[0, len(text)]]
                else:
                    for s in sorted((f["start"], f["end"]) for f in found or ()):
                        if own and s[0] <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], s[1])
                        else:
                            own.append([*s])
                rest, last = [], 0
                for a, e in own:
                    rest.append(text[last:a])
                    last = e
                sizes.append(len(text))
                spans.append([{"start": a, "end": e} for a, e in own])
                kept.append(b"".join([*rest, text[last:]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["k1", "k2", "n_bytes", "spans", "kept"])

    joined = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "found")
    return joined.mapInArrow(remove, "k1 long, k2 int, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(``id_col``, n_bytes, spans, kept) for each row of ``df``."""
    rows = df.select(F.col(id_col).alias("row_id"), *text_keys(F.col(text_col)))
    return rows.join(deduplicated(df, text_col, length), ["k1", "k2"]).select(F.col("row_id").alias(id_col), "n_bytes", "spans", "kept")
