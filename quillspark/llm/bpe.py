"""BPE encoding and decoding by a distinct-word table (operator 4), and encoded lengths for the length histogram (operator 6).

Encoding. Texts are dealt into blocks of about ``BLOCK_BYTES`` by a hash of id and text, and split into words on the JVM. Each block's distinct words
meet in one table of the corpus, dealt into buckets by the word's hash, in which every distinct word is encoded once; the ids go back to the blocks that have the word, and each block lays them out by position.
So texts are shuffled once, and a word travels once for each block, not for each occurrence. The words of one block and bucket travel as one compressed row, and only the ids come back: the block
knows its words, which stand in one order on both ways. Decoding joins ids to their pieces: a lookup in the
table of pieces, which the vocabulary bounds and which is broadcast. Blocks and buckets are sized by a sum over the texts, which runs when the plan is built.

A text that holds a special token's string, or a code point that the JVM's Unicode tables don't know, is a word of its own in the table: the tokenizer splits it.
Null text counts as empty: no ids, empty decoded text. Ids and repeated rows pass through as they are, one row out for each row in; an empty table gives an empty
table. Very long texts are read whole: a block holds a text at least, so a task's memory is bounded by ``BLOCK_BYTES``, a bucket's words (about ``BUCKET_BYTES`` even if all words differ) and the longest text. Rows equal in id and text share a block.
Other columns aren't returned, so their names can't clash.

Lengths alone (operator 6) need no positions: each task keeps the lengths of the distinct words it has met, and nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import released, small_batches

#: Fixed value: how the byte-level vocabulary splits a text into words.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of the table of words: no bucket has more bytes of words, about.
BUCKET_BYTES = 32 << 20
#: Words encoded at once, and then kept as numbers.
ENCODE_WORDS = 100_000
#: Words of a block laid out at once, about.
LAY_WORDS = 500_000
#: A task's table of lengths is emptied beyond so many words, which bounds its memory and changes no result.
TABLE_WORDS = 1_000_000


def split_columns(text: Column, specials: list[str]) -> list[Column]:
    """``odd``: whether only the tokenizer splits the text rightly; ``words``, which are then the whole text."""
    odd = text.rlike(r"\p{Cn}")
    for s in specials:
        odd = odd | text.contains(s)
    return [odd.alias("odd"), F.when(odd, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))).alias("words")]


def specials_of(path: str) -> list[str]:
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


class WordTable:
    """Encodes words, and keeps the lengths of those it has met."""

    def __init__(self, source: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(source)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.own_split = self.whole.pre_tokenizer
        self.one_word = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, int] = {}

    def encoded(self, odd: list[bool], words: list[str]) -> list[list[int]]:
        """Ids of each word; ``odd`` ones are split by the tokenizer."""
        self.whole.pre_tokenizer = self.one_word
        ids = []
        for i in range(0, len(words), 4096):
            part = ["" if o else w for o, w in zip(odd[i : i + 4096], words[i : i + 4096])]
            ids += [e.ids for e in self.whole.encode_batch_fast(part, add_special_tokens=False)]
        self.whole.pre_tokenizer = self.own_split
        for i, o in enumerate(odd):
            if o:
                ids[i] = self.whole.encode(words[i], add_special_tokens=False).ids
        return ids

    def lengths(self, odd, words):
        """Tokens of each row of an Arrow list of words."""
        import numpy as np
        import pyarrow.compute as pc

        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        parents = np.repeat(np.arange(len(counts)), counts)
        values = pc.list_flatten(words).dictionary_encode()
        index = values.indices.to_numpy()
        distinct = values.dictionary.to_pylist()
        if len(self.known) > TABLE_WORDS:
            self.known = {}
        is_odd = np.zeros(len(distinct), bool)
        is_odd[index[np.array(odd, bool)[parents]]] = True
        new = [k for k, w in enumerate(distinct) if w not in self.known]
        for k, ids in zip(new, self.encoded(is_odd[new].tolist(), [distinct[k] for k in new])):
            self.known[distinct[k]] = len(ids)
        size = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))
        return np.bincount(parents, size[index], len(counts)).astype(np.int64)


def _source(tokenizer: str) -> str:
    """A tokenizer file's text, which goes with the tasks: executors need no file of the driver's."""
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def by_position(lengths):
    """The order that puts the first values of all stretches of such lengths first, then the second ones, and so on. Neighbours of sorted words begin alike, so these compress better."""
    import numpy as np

    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    return np.argsort(at.astype(np.uint16) if len(at) and at.max() < 2**16 else at, kind="stable")


def planes(values) -> bytes:
    """Numbers with the lowest bytes of all first, then the next ones, and so on."""
    import numpy as np

    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def squeezed(lengths, values) -> bytes:
    """Stretches of ``values`` (bytes or 32-bit numbers, one after another) and their lengths, compressed."""
    import struct

    import numpy as np
    import pyarrow as pa

    raw = planes(np.asarray(lengths).astype("<u4")) + planes(values[by_position(np.asarray(lengths, np.int64))])
    return struct.pack("<IQ", len(lengths), len(raw)) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unsqueezed(blob: bytes, kind: str) -> tuple:
    """Lengths and values; ``kind``: their numpy type."""
    import struct

    import numpy as np
    import pyarrow as pa

    def numbers(raw: bytes, kind: str):
        wide = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
        return np.ascontiguousarray(wide.T).view(kind)[:, 0]

    n, size = struct.unpack_from("<IQ", blob)
    raw = pa.Codec("zstd").decompress(blob[12:], size, asbytes=True)
    lengths = numbers(raw[: 4 * n], "<u4").astype(np.int64)
    laid = numbers(raw[4 * n :], kind)
    values = np.empty_like(laid)
    values[by_position(lengths)] = laid
    return lengths, values


def block_words(rows, buckets: int) -> tuple:
    """The distinct words of a block's rows (odd, words), and the bucket of each, odd for those that the tokenizer splits. They stand by bucket, then byte by byte, whatever the order of the rows."""
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    found, at = [], []
    any_odd = pc.any(rows.column("odd")).as_py()
    for odd in (False, True) if any_odd else (False,):
        words = rows.filter(pc.equal(rows.column("odd"), odd)).column("words") if any_odd else rows.column("words")
        distinct = pc.unique(pc.list_flatten(words))
        distinct = distinct.take(pc.sort_indices(distinct))
        found.append(distinct)
        at.append(np.fromiter(map(zlib.crc32, distinct.cast(pa.binary()).to_pylist()), np.int64, len(distinct)) % buckets * 2 + odd)
    at = np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return pa.concat_arrays(found).take(pa.array(order)), at[order]


def gathered(pool, first, size, index):
    """The stretches of ``pool`` that the entries of ``index`` stand for, one after another; ``first``, ``size``: where each entry's begins, and how long it is."""
    import numpy as np

    each = size[index]
    ends = np.cumsum(each)
    return pool[np.repeat(first[index] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]


def word_ids(words: DataFrame, tokenizer: str) -> DataFrame:
    """(at, bucket, ids binary) for each row of ``words`` (at, bucket, words: squeezed). Equal words of all blocks meet in their bucket, and are encoded once."""
    model = words.sparkSession.sparkContext.broadcast(_source(tokenizer))
    held: list[WordTable] = []  # a task's

    def run(group):
        import numpy as np
        import pyarrow as pa

        if not held:
            held.append(WordTable(model.value))
        parts = [unsqueezed(x, "u1") for x in group.column("words").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([x for x, _ in parts]))])
        cuts = np.cumsum([0, *[len(x) for x, _ in parts]]).tolist()
        keys = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([x for _, x in parts]))).dictionary_encode()
        index, distinct = keys.indices.to_numpy(), keys.dictionary
        del parts, keys
        odd = group.column("bucket")[0].as_py() % 2 == 1
        size, pool = [], []
        for i in range(0, len(distinct), ENCODE_WORDS):
            some = distinct.slice(i, ENCODE_WORDS).to_pylist()
            ids = held[0].encoded([odd] * len(some), some)
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            pool.append(np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(size[-1].sum())))
        size, pool = np.concatenate(size), np.concatenate(pool)
        first = np.cumsum(size) - size
        found = [squeezed(size[index[a:b]], gathered(pool, first, size, index[a:b])) for a, b in itertools.pairwise(cuts)]
        out = pa.table({"at": group.column("at"), "bucket": group.column("bucket"), "ids": pa.array(found, pa.binary())})
        released()
        return out

    return words.groupBy("bucket").applyInArrow(run, "at int, bucket int, ids binary")


def laid_out(rows, table, buckets: int, pieces=None):
    """row_id, n_tokens and ids of a block's rows (row_id, block, odd, words), by position; ``table``: the ids of the block's words (at, bucket, ids). With ``pieces`` (see ``piece_arrays``) also the decoded text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.combine_chunks()
    # a text that the tokenizer splits never equals a word of the others: it holds a special token or an unknown code point
    piece, _ = block_words(rows, buckets)
    parts = [unsqueezed(x, "<u4") for x in table.sort_by("bucket").column("ids").to_pylist()]
    size = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in parts]])
    pool = np.concatenate([np.zeros(0, "<u4"), *[x for _, x in parts]])
    if len(size) != len(piece):
        raise RuntimeError("a block's words changed while they were encoded")
    first = np.cumsum(size) - size
    del parts

    def part(words):
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(words)
        at = pc.index_in(flat, value_set=piece).to_numpy() if len(flat) else np.zeros(0, np.int64)
        laid = gathered(pool, first, size, at)
        tokens = np.bincount(np.repeat(np.arange(len(counts)), counts), size[at], len(counts)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(tokens)])
        raw = laid.tobytes()
        out = [pa.array(tokens), pa.array([raw[4 * a : 4 * b] for a, b in itertools.pairwise(bounds.tolist())], pa.binary())]
        return [*out, pa.array(decoded(laid, bounds, pieces), pa.string())] if pieces else out

    done, words = [], rows.column("words")
    total = np.cumsum(pc.list_value_length(words).to_numpy()) // LAY_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(words)]
    for a, b in zip(cuts, cuts[1:]):
        done.append(part(words.slice(a, b - a).combine_chunks()))
    names = ["n_tokens", "ids", *["decoded"] * bool(pieces)]
    out = pa.table({"row_id": rows.column("row_id"), **{n: pa.chunked_array([x[k] for x in done]) for k, n in enumerate(names)}})
    done.clear()
    released()
    return out


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded_col: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(``id_col``, n_tokens long, ids binary: little-endian unsigned 32-bit), one row for each row of ``df``. tokenizer: path of a byte-level tokenizer file. decoded_col: also the text that the ids decode to, joined to their pieces in the same task."""
    small_batches(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(piece_arrays(tokenizer)) if decoded_col else None
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = -(-total // bucket_bytes) or 1
    block = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(-(-total // block_bytes) or 1)).cast("int")
    rows = df.select(F.col(id_col).alias("row_id"), text.alias("text"), block.alias("block")).repartition("block")  # both uses below have this exchange
    # sorted as texts, which take less room than words; the ids are asked for in both uses, else their exchanges would differ
    rows = rows.sortWithinPartitions("block").select("row_id", "block", *split_columns(F.col("text"), specials_of(tokenizer)))

    def distinct(group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, at = block_words(group.combine_chunks(), buckets)
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(words)] if len(words) else []
        parts = [words.slice(a, b - a) for a, b in itertools.pairwise(cuts)]
        found = [squeezed(pc.binary_length(x).to_numpy(), np.frombuffer(b"".join(x.cast(pa.binary()).to_pylist()), np.uint8)) for x in parts]
        out = pa.table({"at": pa.array([group.column("block")[0].as_py()] * len(found), pa.int32()), "bucket": pa.array(at[cuts[:-1]], pa.int32()), "words": pa.array(found, pa.binary())})
        released()
        return out

    asked = word_ids(rows.groupBy("block").applyInArrow(distinct, "at int, bucket int, words binary"), tokenizer)
    kind = df.schema[id_col].dataType.simpleString()
    lay = (lambda rows, table: laid_out(rows, table, buckets, pieces.value)) if decoded_col else (lambda rows, table: laid_out(rows, table, buckets))
    out = rows.groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(lay, f"row_id {kind}, n_tokens long, ids binary" + ", decoded string" * bool(decoded_col))
    return out.select(F.col("row_id").alias(id_col), "n_tokens", "ids", *([F.col("decoded").alias(decoded_col)] if decoded_col else []))


def encoded_lengths(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens long) without laying out the ids."""
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(_source(tokenizer))
    rows = df.select(F.col(id_col).alias("row_id"), *split_columns(F.coalesce(F.col(text_col), F.lit("")), specials_of(tokenizer)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = None
        for b in batches:
            if b.num_rows:
                table = table or WordTable(model.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(table.lengths(b.column(1).to_pylist(), b.column(2)), pa.int64())], names=["row_id", "n_tokens"])
        table = None
        released()

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {kind}, n_tokens long").withColumnRenamed("row_id", id_col)


def piece_table(tokenizer: str) -> list[bytes]:
    """Bytes of the piece of each id; the byte alphabet is the public byte-level one: printable Latin-1 stands for itself, the rest follow from U+0100."""
    from tokenizers import Tokenizer

    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    vocabulary = Tokenizer.from_file(tokenizer)
    pieces = [b""] * (max(vocabulary.get_vocab().values()) + 1)
    for piece, i in vocabulary.get_vocab().items():
        pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    return pieces


def piece_arrays(tokenizer: str) -> tuple:
    """Bytes of all pieces, where each id's begin, and their sizes."""
    import numpy as np

    pieces = piece_table(tokenizer)
    sizes = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes


def decoded(ids, bounds, pieces: tuple) -> list[str]:
    """Texts of the ids between neighbouring ``bounds``: each id looks up its piece."""
    import numpy as np

    data, first, sizes = pieces
    n = sizes[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    raw = data[np.repeat(first[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(ends[bounds].tolist())]


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the text of the little-endian ids of ``ids_col``, by a join with the table of pieces, which has a row for each id of the vocabulary. Null: null."""
    shared = df.sparkSession.sparkContext.broadcast(piece_arrays(tokenizer))
    at = df.columns.index(ids_col)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = [None if x is None else np.frombuffer(x, "<u4") for x in b.column(at).to_pylist()]
            texts = [None if x is None else decoded(x, np.array([0, len(x)]), shared.value)[0] for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])
        released()

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))
