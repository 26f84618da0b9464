"""The operators against brute force, on texts with nulls, empties, copies, ties and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, fmindex, kd_shards, line_templates, pii, quality_rules, secret_scan, simhash, suffix_dedup, token_counts
from quillspark.llm.queries import tokenizer_path

SPACE = r"[^\x20\x09-\x0D]+"


def made(seed=5, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghé") for _ in range(r.randint(1, 6)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 14)))
    shared = [line() for _ in range(4)] + [" ".join(word() for _ in range(60))]
    out = [None, "", " \n\t", "x", "日本語 テキスト", "a" * 3000, "<|endoftext|> a<|endoftext|>", "🙂 ok b  c   d\n\n e's", "A\x00b\x1cc"]
    for i in range(n):
        lines = [line() for _ in range(r.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(shared))
        out.append("\n".join(lines))
    return out + [out[12], out[12], out[15] + " tail", out[20].replace("a", "A")]


TEXTS = made()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in enumerate(TEXTS)] + [(12, TEXTS[12], "en", "s0", 12), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, word int").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_empty_tables_run(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    path = tokenizer_path()
    for df in (
        line_templates.drop_recurring_lines(none), quality_rules.with_rules(none, quality_rules.weights(none, labels)), kd_shards.shards(none, n_shards=4), bpe.decode(bpe.encode(none, path), path),
        suffix_dedup.dedup(none), token_counts.suffix_sums(token_counts.length_histogram(bpe.encoded_lengths(none, path))), fmindex.search(none, items), simhash.near_duplicates(none), pii.find(none),
    ):
        assert df.count() == 0
    assert {r["leaks"]["n_hit"] for r in fmindex.search(docs, items).collect()} == {0}


def test_bpe_round_trip(docs):
    tk = Tokenizer.from_file(tokenizer_path())
    got = by_id(bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()))
    lengths = by_id(bpe.encoded_lengths(docs, tokenizer_path()))
    both = by_id(bpe.encode(docs, tokenizer_path(), block_bytes=2000, decoded_col="again"))
    for i, t in enumerate(TEXTS):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids, (i, t)
        assert got[i]["n_tokens"] == lengths[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == both[i]["again"] == tk.decode(ids, skip_special_tokens=False)
        assert both[i]["ids"] == got[i]["ids"]


def test_bpe_words_travel_squeezed(spark):
    """One compressed row for each block and bucket, which holds each of its words once, and nothing but lengths and ids on the way back."""
    r = random.Random(4)
    some = ["".join(r.choice("abcdefghij") for _ in range(r.choice([2, 5, 9]))) for _ in range(1500)]
    texts = [" ".join(r.choices(some, k=300)) for _ in range(60)] + ["", None, "<|endoftext|> a", "\u0378 b", "x" * 70_000 + " <|endoftext|>", "\U0001f600 z\n\n  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    tk = Tokenizer.from_file(tokenizer_path())
    for block, bucket in ((20_000, 7_000), (1, 1 << 20), (1 << 30, 1 << 30)):
        got = by_id(bpe.encode(df, tokenizer_path(), block_bytes=block, bucket_bytes=bucket, decoded_col="again"))
        for i, t in enumerate(texts):
            ids = tk.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["again"] == tk.decode(ids, skip_special_tokens=False)
    rows = pa.table({"odd": [False, False, True], "words": [["b", " a", "b"], [], ["a<|endoftext|>"]]})
    again = pa.table({"odd": [True, False], "words": [["a<|endoftext|>"], [" a", "b", " a"]]})
    words, at = bpe.block_words(rows, 5)
    assert sorted(words.to_pylist()) == [" a", "a<|endoftext|>", "b"] and {w for w, k in zip(words.to_pylist(), at) if k % 2} == {"a<|endoftext|>"}
    assert (np.diff(at) >= 0).all() and bpe.block_words(again, 5)[0].equals(words) and bpe.block_words(again, 5)[1].tolist() == at.tolist()
    own = sorted({w.encode() for w in some})
    sizes, data = np.array([len(w) for w in own]), np.frombuffer(b"".join(own), np.uint8)
    packed = bpe.squeezed(sizes, data)
    assert len(packed) < 0.5 * len(data)
    for lengths, values, kind in ((sizes, data, "u1"), (np.array([0, 3, 0, 1]), np.array([5, 1 << 31, 7, 9], "<u4"), "<u4"), (np.zeros(0, int), np.zeros(0, "<u4"), "<u4"), (np.array([70_000]), np.arange(70_000, dtype="<u4"), "<u4")):
        back = bpe.unsqueezed(bpe.squeezed(lengths, values), kind)
        assert back[0].tolist() == lengths.tolist() and back[1].tolist() == values.tolist()


def test_histogram_answers(spark):
    lengths = [0, 0, 3, 3, 5, 2000, 5000]
    sums = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))).cache()
    for r in sums.collect():
        limit = r["n_tokens"]
        assert r["truncated_tokens"] == sum(min(x, limit) for x in lengths) and r["docs_at_least"] == sum(x >= limit for x in lengths)
        assert r["docs_up_to"] == sum(x <= limit for x in lengths) and r["tokens_up_to"] == sum(x for x in lengths if x <= limit) and r["total_tokens"] == sum(lengths)
    got = {r["context_limit"]: (r["docs_longer"], r["truncated_tokens"]) for r in token_counts.for_limits(sums, [0, 4, 9999]).collect()}
    assert got == {k: (sum(x > k for x in lengths), sum(min(x, k) for x in lengths)) for k in (0, 4, 9999)}
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: 3, 1.0: 5000}


def test_quality_base_counts(spark, docs):
    labels = spark.createDataFrame([(20, 1, 0), (21, 1, None), (22, 0, 0), (None, 1, 0), (20, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_rules.weights(docs, labels)
    assert len(model) == quality_rules.BUCKETS and any(model)
    got = by_id(quality_rules.with_rules(docs, model))
    for i, t in enumerate(TEXTS):
        w, r = re.findall(SPACE, t or ""), got[i]["rules"]
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), t
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = [x - (x >> 63 << 64) for x in h]
        pairs = [xxhash.xxh64_intdigest((b % 2**64).to_bytes(8, "little"), xxhash.xxh64_intdigest((a % 2**64).to_bytes(8, "little"), 42)) for a, b in zip(signed, signed[1:])]
        cells = [x % quality_rules.BUCKETS for x in signed] + [(x - (x >> 63 << 64)) % quality_rules.BUCKETS for x in pairs]
        if cells:
            assert r["score"] == pytest.approx(sum(model[c] for c in cells) / len(cells))
        assert r["kept"] == (not r["base_failed"] and (r["score"] or 0) >= quality_rules.THRESHOLD)


def test_shards_are_even_and_gapless(docs):
    rows = kd_shards.shards(docs, n_shards=5).collect()
    assert len(rows) == docs.count() and {r["shard"] for r in rows} <= set(range(5))
    for k in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"] is not None} == {i: len((t or "").encode()) + 16 for i, t in enumerate(TEXTS)}
    big = docs.crossJoin(docs.sparkSession.range(40)).where("length(text) < 1000").select(F.monotonically_increasing_id().alias("doc_id"), "text", "lang", "source")
    sizes = [r[1] for r in kd_shards.shards(big, n_shards=7).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 7 and max(sizes) < 1.1 * min(sizes)
    assert kd_shards.shards(docs, target_bytes=10**9).select("shard").distinct().count() == 1


def test_line_templates(spark):
    boiler = [f"Order {i} was shipped to customer {i * 7} on day {i % 5} by the carrier" for i in range(6)]
    named = [f"Dear {n} we thank you for your kind order of yesterday" for n in ("Ann", "Bob", "Cid", "Dee", "Eve", "Fay")]
    texts = [f"{' '.join(chr(97 + i) * k for k in range(1, 9))}\n{boiler[i]}\n{named[i]}\nshort" for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, texts[0]), (91, None), (92, "")]
    got = by_id(line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), lead=1))
    assert got[0]["line_dedup"]["text"] == texts[0] == got[90]["line_dedup"]["text"]  # first text, and its copy
    for i in range(1, 6):
        assert got[i]["line_dedup"]["n_dropped"] == 2 and got[i]["line_dedup"]["text"] == texts[i].split("\n")[0] + "\nshort"
    assert got[91]["line_dedup"]["text"] is None and got[92]["line_dedup"]["text"] == "" and got[1]["text"] == texts[1]


def brute_suffix(texts, n=200):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                mark[i] += 1
                mark[i + n] -= 1
        out.append(bytes(c for c, k in zip(b, np.cumsum(mark)) if not k))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = by_id(suffix_dedup.dedup(docs))
    extended = [*TEXTS, TEXTS[12], "no id"]
    for i, kept in enumerate(brute_suffix(extended)[: len(TEXTS)]):
        assert rows[i]["kept"] == kept, i
        assert sum(s["end"] - s["start"] for s in rows[i]["spans"]) == rows[i]["n_bytes"] - len(kept)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_core(seed):
    r = random.Random(seed)
    n, a = r.choice([(20, 6), (30, 8), (200, 48)])
    base = bytes(r.choice(b"ab" if seed % 3 else b"abcdefgh") for _ in range(400))
    texts = set()
    for _ in range(30):
        t = b""
        for _ in range(r.randint(1, 4)):
            i = r.randint(0, 300)
            t += base[i : i + r.randint(1, 300)] if r.random() < 0.6 else bytes(r.choice(b"abcdefgh") for _ in range(r.randint(0, 60)))
        texts.add(t)
    texts = sorted(texts)
    h, owner, at = suffix_dedup.Anchors(n, a).of(texts)
    chunks = []
    for part in range(4):
        entries = [(texts[t][p : p + n], texts[t][max(0, p - n + a) : p][::-1], bytes((t,)) + int(p).to_bytes(4, "little")) for t, p in zip(owner.tolist(), at.tolist()) if t % 4 == part]
        entries.sort()
        assert [(s, x, p) for _, s, x, p in suffix_dedup.front_decode(suffix_dedup.front_code(entries), 5)] == entries
        size = r.choice([1, 3, 1000])
        chunks += [(entries[i][0], suffix_dedup.front_code(entries[i : i + size])) for i in range(0, len(entries), size)]
    chunks = [c for _, c in sorted(chunks, key=lambda x: x[0])]
    merged = [(lcp, s) for lcp, s, _, _ in suffix_dedup.merge(iter(chunks), 5)]
    assert [s for _, s in merged] == sorted(texts[t][p : p + n] for t, p in zip(owner.tolist(), at.tolist()))
    assert all(lcp == suffix_dedup.shared_prefix(a, b) for (_, a), (lcp, b) in zip(merged, merged[1:]))
    mark = [[False] * len(t) for t in texts]
    for p, before, beyond in suffix_dedup.repeated_spans(chunks, n, a, 5):
        for k in range(int.from_bytes(p[1:], "little") - before, int.from_bytes(p[1:], "little") + beyond):
            mark[p[0]][k] = True
    counts = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t, m in zip(texts, mark):
        want = [False] * len(t)
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                want[i : i + n] = [True] * n
        assert m == want


def test_fm_index_finds_and_locates():
    r = np.random.default_rng(1)
    sequence = r.integers(0, 5, 400)
    index = fmindex.FMIndex(sequence, 5)
    for size in (1, 2, 4):
        patterns = r.integers(0, 5, (30, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(sequence) - size + 1) if (sequence[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, docs):
    words = (TEXTS[30] or "").split()
    items = [(1, " ".join(words[2:19]).upper()), (1, " ".join(words[2:19])), (2, "x"), (3, ""), (4, None), (None, " ".join(words[:13])), (5, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("" if i is None else str(i))
    for block in (fmindex.BLOCK_BYTES, 30):
        got = by_id(fmindex.search(docs, bench, block_bytes=block))
        for i, t in enumerate(TEXTS):
            w, hit, found = split(t), set(), set()
            for k in range(len(w)):
                for p, owners in windows.items():
                    if tuple(w[k : k + len(p)]) == p:
                        hit.update(range(k, k + len(p)))
                        found |= owners
            r = got[i]["leaks"]
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)), t
            if hit:
                assert split("".join(t[s["start"] : s["end"]] + " " for s in r["spans"])) == [x for k, x in enumerate(w) if k in hit]
                cut = t
                for s in reversed(r["spans"]):
                    cut = cut[: s["start"]] + cut[s["end"] :]
                assert r["clean_text"] == cut


def test_simhash_components(docs):
    prints = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 12:
                a, b = root[i], root[j]
                for k, v in root.items():
                    if v in (a, b):
                        root[k] = min(a, b)
    for tile in (simhash.TILE, 2):
        got = by_id(simhash.near_duplicates(docs, radius=12, tile=tile))
        assert {i: got[i]["fp"] % 2**64 for i in prints} == prints
        assert {i: got[i]["component_id"] for i in prints} == root


def test_chain_of_links_is_one_component(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_personal_data(spark):
    model = pii.tagger()
    test = pii.written(300, 991)
    found = pii.spans_of(model, [t for t, _ in test])
    hits = sum(any(k == s[0] and s[1] < b and a < s[2] for s in f) for f, (_, spans) in zip(found, test) for k, a, b in spans)
    assert hits >= 0.8 * sum(len(s) for _, s in test)  # held-out texts of the generator
    extra = sum(not base and not any(s < b and a < e for _, a, b in spans) for f, (_, spans) in zip(found, test) for _, s, e, base in f)
    assert extra <= 0.1 * hits
    texts = ["mail a.b@c.example.org, ip 10.0.0.300 or 10.0.0.3 and +1 (578) 555-6437 4918187128635271", "a@b", "x@y.z@w.v", None, "", "clean words only", "@" * 50, "1" * 3000]
    got = {r["doc_id"]: r["personal"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        base = [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]]
        assert base == [(k, *m.span()) for k, p in pii.PATTERNS.items() for m in re.finditer(p, t or "") if pii.fits(k, m[0])]
    assert ("phone", 54, 71) in [(s["kind"], s["start"], s["end"]) for s in got[0]]  # the pattern runs on into the card number


def test_secrets(spark):
    model = secret_scan.log_ratios(secret_scan.samples(spark))
    judged = lambda df, m: df.withColumn("v", secret_scan.score(F.col("s"), m) >= F.greatest(F.lit(secret_scan.MARGIN), secret_scan.RATE * F.length("s")))
    half = secret_scan.log_ratios(secret_scan.samples(spark, ordinary_words=secret_scan.WORDS[::2]))
    held = judged(secret_scan.samples(spark, 500, first=100_000, ordinary_words=secret_scan.WORDS[1::2]).where("length(s) >= 20"), half)  # held-out words and strings
    rates = {r["random"]: r["rate"] for r in held.groupBy("random").agg(F.avg((F.col("v") == F.col("random")).cast("int")).alias("rate")).collect()}
    assert rates[True] >= 0.95 and rates[False] >= 0.95, rates
    usual = ["UserRepositoryServiceProxyTest", "transaction_processing_queue", "vectorized-table-printer-options", "resources/widgets/panel/window", "WorkspaceNotificationSender"]
    assert not judged(spark.createDataFrame([(x,) for x in usual], "s string"), model).where("v").count()
    texts = ["password=b7db7aa4a5fcc78305 token=token:abcdefg", 'API-KEY api_key: "Abc_123"', "AKIA" + "A1" * 8 + " AKIAshort", "deadbeef" * 3, "🙂 TOKEN = 'x" + "y" * 9, None, "", "key Zm9vYmFyQUJDREVGR0hJ9x7Qk3PzLw end", "secret=" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(secret_scan.find(df, model))
    patterns = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))
    least = (6, 20, 24)
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= least[k])
        assert [(s["start"], s["rank"], s["end"]) for s in got[i]["secrets"] if s["kind"] != "markov"] == want, t
    assert [s["kind"] for s in got[7]["secrets"]] == ["markov"]


def test_equal_rows_part_between_shards(spark):
    same = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x y z").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r["count"] for r in kd_shards.shards(same, n_shards=5).groupBy("shard").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 30
    named = spark.createDataFrame([(f"doc-{i}", "x" * i, "en", "s") for i in range(200)], "doc_id string, text string, lang string, source string")
    rows = kd_shards.shards(named, n_shards=4).collect()
    assert {r["doc_id"] for r in rows} == {f"doc-{i}" for i in range(200)} and {r["shard"] for r in rows} == set(range(4))


def test_clashing_columns_pass_through(spark):
    names = ["_w", "_h", "_base", "_more", "row", "t", "w", "h", "l", "n", "r", "b", "s", "base", "more", "c0", "rules", "secrets"]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(["a b " * 20, None, "", "password=abcdef1"])], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    for out, col in ((quality_rules.with_rules(df, [0.0] * quality_rules.BUCKETS), "rules"), (secret_scan.find(df, secret_scan.log_ratios(secret_scan.samples(spark, 50))), "secrets")):
        assert sorted(out.columns) == sorted(df.columns)
        for r in out.collect():
            assert [r[c] for c in names if c != col] == [k for k, c in enumerate(names) if c != col]
