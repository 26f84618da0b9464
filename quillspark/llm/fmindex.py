"""Benchmark decontamination (operator 7): an FM-index over each training shard, searched for the benchmark's windows.

A shard is one Arrow batch of documents. Its words become ids of the benchmark's vocabulary; words outside it can't be part of a
window, and neither can runs shorter than the shortest window, so both leave the indexed sequence as separators (this is exact). The sequence gets a
suffix array, its Burrows-Wheeler transform goes into a wavelet matrix with rank by bit counts, and all windows are searched
backwards at once. Occurrences are located by walking to the next sampled suffix position. Each hit is compared with the
window's bytes, spans are merged, and hits counted.

The benchmark is a stated query set: it is read in blocks of a bounded size, one broadcast each, and every block meets every shard.
Nothing is shuffled.

Null text: no words. Empty benchmark: no hits. Items without words are never found. Equal item ids count once; a null item id
counts as the empty string. Repeated rows each come back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import small_batches

#: UTF-8 bytes of benchmark text in one broadcast block, about.
BLOCK_BYTES = 8_000_000
#: Every so many suffix positions are kept.
SAMPLE = 8

#: What ``search`` adds to the documents.
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def word_bounds(data, firsts):
    """Starts and ends of words in lower-cased bytes; a word never crosses one of ``firsts``, where texts begin."""
    import numpy as np

    kind = np.zeros(256, bool)
    kind[48:58] = kind[97:123] = kind[128:] = True
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = firsts[firsts < len(data)]
    begins[firsts] = inside[firsts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    before = firsts[firsts > 0] - 1
    closes[before] = inside[before]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def lower(data):
    import numpy as np

    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    return to[data]


def word_hashes(data, starts, ends, longest: int):
    """A 64-bit hash of each word of at most ``longest`` bytes. It only finds candidates: what it finds is compared byte for byte."""
    import numpy as np

    out = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    length = ends - starts
    k, left = 0, np.flatnonzero(length <= longest)
    while True:
        live = length[left] > k
        left = left[live]
        if not len(left):
            return out
        out[left] = (out[left] ^ data[starts[left] + k]) * np.uint64(0x100000001B3)
        out[left] ^= out[left] >> np.uint64(29)
        k += 1


class Windows:
    """The benchmark's windows as sequences of word ids (from 1), with the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        import numpy as np

        ids: dict[bytes, int] = {}
        self.items: list[str] = []
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for name, text in items:
            data = lower(np.frombuffer(text, np.uint8))
            line = data.tobytes()
            words = [line[a:b] for a, b in zip(*map(lambda x: x.tolist(), word_bounds(data, np.zeros(1, np.int64))))]
            if words:
                k = names.setdefault(name, len(names))
                row = [ids.setdefault(w, len(ids) + 1) for w in words]
                for i in range(max(1, len(row) - size + 1)):
                    found.setdefault(tuple(row[i : i + size]), set()).add(k)
        self.items = list(names)
        self.windows = [np.array(w, np.int64) for w in found]
        self.owners = [sorted(x) for x in found.values()]
        self.least = min((len(w) for w in self.windows), default=0)
        words = list(ids)
        self.size = len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words]).astype(np.int64) if words else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64) if words else ends
        self.longest = max(map(len, words), default=0)
        hashes = word_hashes(data, starts, ends, self.longest)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], order + 1
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two benchmark words share a hash")
        self.data, self.starts, self.ends = data, starts, ends
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def word_ids(self, data, starts, ends, hashes):
        """Id of each word, 0 for those outside the vocabulary."""
        import numpy as np

        out = np.zeros(len(starts), np.int64)
        near = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        if not self.size or not len(near):
            return out
        k = np.minimum(np.searchsorted(self.hashes, hashes[near]), self.size - 1)
        same = self.hashes[k] == hashes[near]
        near, found = near[same], self.ids[k[same]]
        out[near] = np.where(ends[near] - starts[near] == self.ends[found - 1] - self.starts[found - 1], found, 0)
        return out

    def really(self, data, starts, ends, words):
        """Whether each document word is, byte for byte, the vocabulary word that its hash says."""
        import numpy as np

        good = np.ones(len(starts), bool)
        first, length = self.starts[words - 1], ends - starts
        for k in range(int(length.max(initial=0))):
            live = length > k
            good[live] &= data[starts[live] + k] == self.data[first[live] + k]
        return good


def suffix_array(sequence):
    """Order of all suffixes, by prefix doubling."""
    import numpy as np

    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k if k < n else 0] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = step
        if step[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Rank of any symbol before any position, by bit vectors with counts for each 64 bits."""

    def __init__(self, sequence, size: int):
        import numpy as np

        self.n, self.levels = len(sequence), max(1, int(size).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = ((sequence >> level) & 1).astype(np.uint8)
            packed = np.zeros(-(-(self.n + 1) // 64) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            packed = packed.view("<u8")
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(int(self.n - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def ones(self, level: int, at):
        import numpy as np

        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[level][word] + np.bitwise_count(self.bits[level][word] & mask).astype(np.int64)

    def rank(self, symbol, at):
        import numpy as np

        low = np.zeros_like(at)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self.ones(k, low), self.ones(k, at)
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return at - low


class FMIndex:
    """Backward search over a sequence of ids (0: separator) and places of what it finds."""

    def __init__(self, sequence, size: int):
        import numpy as np

        sequence = np.concatenate([sequence + 1, [0]])  # the end mark is smaller than all
        order = suffix_array(sequence)
        self.transform = sequence[order - 1]
        self.matrix = WaveletMatrix(self.transform, size + 2)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=size + 2))])
        self.marked = order % SAMPLE == 0
        self.place = np.zeros(len(order), np.int64)
        self.place[self.marked] = order[self.marked]

    def step(self, symbol, at):
        return self.before[symbol] + self.matrix.rank(symbol, at)

    def search(self, patterns):
        """Ranges of suffixes that begin with each pattern: equal lengths, a row each."""
        import numpy as np

        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.transform), np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[live, k] + 1
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows):
        import numpy as np

        rows, steps, left = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while True:
            left = left[~self.marked[rows[left]]]
            if not len(left):
                return self.place[rows] + steps
            rows[left] = self.step(self.transform[rows[left]], rows[left])
            steps[left] += 1


def occurrences(windows: Windows, ids, text_of_word):
    """(window, first word) of every occurrence among the words of a shard. A window never crosses texts."""
    import numpy as np

    n = len(ids)
    if not windows.least or not n:
        return np.zeros((0, 2), np.int64)
    in_run = ids > 0
    new = in_run.copy()
    new[1:] &= ~in_run[:-1] | (text_of_word[1:] != text_of_word[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    length = np.bincount(run[in_run], minlength=len(first))
    keep = np.flatnonzero(in_run)
    keep = keep[length[run[keep]] >= windows.least]
    if not len(keep):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(run[keep])) + 1
    sequence = np.insert(ids[keep], gap, 0)
    place = np.insert(keep, gap, -1)
    index = FMIndex(sequence, windows.size)
    found = []
    sizes = np.array([len(w) for w in windows.windows])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        low, high = index.search(np.stack([windows.windows[i] for i in own]))
        count = high - low
        if count.sum():
            end = np.cumsum(count)
            rows = np.repeat(low - end + count, count) + np.arange(end[-1])
            found.append(np.stack([np.repeat(own, count), place[index.locate(rows)]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def hits(blocks: list[Windows], texts: list[bytes]):
    """For each text: its number of words, the merged spans of hit words as byte offsets, the number of hit words, the items found."""
    import numpy as np

    size = np.array([len(t) for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(size)])
    data = lower(np.frombuffer(b"".join(texts), np.uint8))
    starts, ends = word_bounds(data, firsts[:-1])
    text_of_word = np.searchsorted(firsts, starts, side="right") - 1
    n_words = np.bincount(text_of_word, minlength=len(texts))
    hashes = word_hashes(data, starts, ends, max((w.longest for w in blocks), default=0))
    cover = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for w in blocks:
        ids = w.word_ids(data, starts, ends, hashes)
        found = occurrences(w, ids, text_of_word)
        if len(found):
            sizes = np.array([len(w.windows[i]) for i in found[:, 0]])
            end = np.cumsum(sizes)
            word = np.repeat(found[:, 1] - end + sizes, sizes) + np.arange(end[-1])
            bad = ~w.really(data, starts[word], ends[word], ids[word])
            good = np.add.reduceat(bad, end - sizes) == 0
            found, sizes = found[good], sizes[good]
            np.add.at(cover, found[:, 1], 1)
            np.add.at(cover, found[:, 1] + sizes, -1)
            pairs = np.unique(np.stack([text_of_word[found[:, 1]], found[:, 0]], 1), axis=0)
            for t, i in pairs.tolist():
                items.setdefault(t, set()).update(w.items[k] for k in w.owners[i])
    hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    spans: dict[int, list[tuple[int, int, int]]] = {}
    if len(hit):
        owner = text_of_word[hit]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner) != 0)]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(hit)]):
            t = int(owner[a])
            spans.setdefault(t, []).append((int(starts[hit[a]] - firsts[t]), int(ends[hit[b - 1]] - firsts[t]), b - a))
    return n_words, spans, items


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list:
    """A broadcast of (item id, text) for each block of the benchmark."""
    context = benchmark.sparkSession.sparkContext
    blocks, block, held = [], [], 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).toLocalIterator():
        block.append((r["i"], r["t"].encode("utf-8", "surrogatepass")))
        held += len(block[-1][1])
        if held >= block_bytes:
            blocks.append(context.broadcast(block))
            block, held = [], 0
    if block:
        blocks.append(context.broadcast(block))
    return blocks


def search(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13, share: int = 20, item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, out_col: str = "leaks", with_clean: bool = True
) -> DataFrame:
    """``df`` with ``out_col``, a struct (see ADDED): word counts, item ids found (sorted as strings), merged spans of hit words as code points, whether a text is contaminated (some word hit, and ``share`` times the hit words at least all words), and the text without its spans (null if it has none)."""
    small_batches(df.sparkSession)
    blocks = blocks_of(benchmark, item_id_col, item_text_col, block_bytes)
    at = df.columns.index(text_col)
    kind = T.StructType([*df.schema.fields, T.StructField(out_col, ADDED)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        found_type = to_arrow_type(ADDED)
        sets = [Windows(x.value, window) for x in blocks]
        for b in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(at).to_pylist()]
            n_words, spans, items = hits(sets, texts)
            rows = []
            for i, t in enumerate(texts):
                n, own = int(n_words[i]), spans.get(i, ())
                n_hit = sum(s[2] for s in own)
                points, rest, last, done = [], [], 0, 0
                for a, e, _ in own:
                    begin = done + len(t[last:a].decode("utf-8", "surrogatepass"))
                    done = begin + len(t[a:e].decode("utf-8", "surrogatepass"))
                    points.append({"start": begin, "end": done})
                    rest.append(t[last:a])
                    last = e
                clean = b"".join([*rest, t[last:]]).decode("utf-8", "surrogatepass") if own and with_clean else None
                rows.append({"n_words": n, "n_hit": n_hit, "items": sorted(items.get(i, ())), "spans": points, "contaminated": n_hit > 0 and share * n_hit >= n, "clean_text": clean})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, found_type)], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, kind)
