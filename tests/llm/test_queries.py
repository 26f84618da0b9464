"""Each registered query over its whole table against brute force. Operators 1 and 7 have theirs in test_line_tree.py and in SQL."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from quillspark.llm import pii, quality_rules, queries, secret_scan

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(df, texts):
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    return {r["doc_id"]: r for r in rows}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def cells(words):
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words]
    signed = lambda x: x - (x >> 63 << 64)
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % quality_rules.BUCKETS for x in h + pairs]


def test_op2(spark, sf, texts):
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]}
    assert 0 < len(trusted) <= quality_rules.TRUSTED
    words = {i: re.findall(SPACE, t) for i, t in texts.items()}
    raw, target = collections.Counter(), collections.Counter()
    for i, w in words.items():
        raw.update(cells(w))
        if i in trusted:
            target.update(cells(w))
    k, s = quality_rules.BUCKETS, quality_rules.SMOOTHING
    weight = [math.log((target[c] + s) / (target.total() + s * k)) - math.log((raw[c] + s) / (raw.total() + s * k)) for c in range(k)]
    got = rows_of(queries.op2_quality_rules(spark, sf), texts)
    for i, t in texts.items():
        w, r = words[i], got[i]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        assert tuple(r[:7]) == (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), failed)
        score = sum(weight[c] for c in cells(w)) / len(cells(w)) if w else 0.0
        assert (r["score"] or 0.0) == pytest.approx(score)
        assert r["kept"] == (not failed and score >= quality_rules.THRESHOLD) or abs(score - quality_rules.THRESHOLD) < 1e-9


def test_op3(spark, sf, texts):
    got = rows_of(queries.op3_kd_shards(spark, sf), texts)
    bytes_of, slots = collections.Counter(), collections.defaultdict(list)
    for i, t in texts.items():
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
        bytes_of[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # a cut misses its goal by less than the row it falls on, and each of a leaf's cuts can: with a few rows for each shard one may stay empty
    most = max(r["size"] for r in got.values())
    mean = sum(bytes_of.values()) / 40
    assert max(abs(b - mean) for b in bytes_of.values()) <= 2 * most


def test_op4_and_op6(spark, sf, texts):
    tk = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: tk.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = rows_of(queries.op4_bpe(spark, sf), texts)
    for i, x in ids.items():
        assert tuple(got[i])[:4] == (i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tk.decode(x, skip_special_tokens=False))), i
    lengths = [len(x) for x in ids.values()]
    sums = {r["n_tokens"]: r.asDict() for r in queries.op6_token_counts(spark, sf).collect()}
    assert set(sums) == set(lengths)
    for n, r in sums.items():
        longer, upto = [x for x in lengths if x >= n], [x for x in lengths if x <= n]
        cut = sum(min(x, n) for x in lengths)
        want = dict(n_docs=lengths.count(n), docs_at_least=len(longer), tokens_at_least=sum(longer), docs_up_to=len(upto), tokens_up_to=sum(upto), total_docs=len(lengths), total_tokens=sum(lengths), truncated_tokens=cut, cut_tokens=sum(lengths) - cut)
        assert {k: r[k] for k in want} == want, n


def test_op5(spark, sf, texts):
    n = 200
    data = {i: t.encode() for i, t in texts.items()}
    counts = collections.Counter(b[k : k + n] for b in data.values() for k in range(len(b) - n + 1))
    got = rows_of(queries.op5_suffix_dedup(spark, sf), texts)
    total = 0
    for i, b in data.items():
        spans = []
        for k in range(len(b) - n + 1):
            if counts[b[k : k + n]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + n
                else:
                    spans.append([k, k + n])
        kept, last = b"", 0
        for s, e in spans:
            kept, last = kept + b[last:s], e
        kept += b[last:]
        assert tuple(got[i])[:5] == (i, len(b), len(b) - len(kept), len(spans), sha(kept)), i
        total += len(spans)
    assert total > 10


def test_op8(spark, sf, texts):
    prints = {}
    for i, t in texts.items():
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and root[i] != root[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root.update({k: min(a, b) for k, v in root.items() if v in (a, b)})
    got = rows_of(queries.op8_simhash(spark, sf), texts)
    assert {i: tuple(got[i])[:3] for i in prints} == {i: (i, f"{prints[i]:016x}", root[i]) for i in prints}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def held(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    return kind == "email" or (16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15)


def read(spans):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def test_op9(spark, sf, texts):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    got = rows_of(queries.op9_pii(spark, sf), texts)
    for i, t in texts.items():
        base = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if held(k, m[0])]
        r, all_ = got[i], read(got[i]["spans"])
        assert [r[f"n_{k}"] for k in patterns] == [sum(b[0] == k for b in base) for k in patterns]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)), i
        assert set(base) <= set(all_) and len(set(all_)) == len(all_)
        assert all_ == sorted(all_, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        for k, a, b in set(all_) - set(base):
            assert k in patterns and 0 <= a < b <= len(t) and held(k, t[a:b])


def test_op10(spark, sf, texts):
    patterns = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 20),
        ("hex", re.compile("[0-9a-f]+"), 24),
    )
    order = [k for k, _, _ in patterns] + ["markov"]
    model = secret_scan.log_ratios(secret_scan.samples(spark))
    place = {c: k for k, c in enumerate(secret_scan.ALPHABET)}
    got = rows_of(queries.op10_secrets(spark, sf), texts)
    for i, t in texts.items():
        base = [(k, *m.span()) for k, p, least in patterns for m in p.finditer(t) if len(m[2] if k == "assign" else m[0]) >= least]
        base.sort(key=lambda s: (s[1], order.index(s[0])))
        r, all_ = got[i], read(got[i]["spans"])
        assert [r[f"n_{k}"] for k in order[:3]] == [sum(b[0] == k for b in base) for k in order[:3]]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)), i
        more = []
        for m in re.finditer(secret_scan.TOKEN, t):
            known = [place.get(c, len(place) - 1) for c in m[0]]
            score = sum(model[a * len(place) + b] for a, b in zip(known, known[1:]))
            if score >= max(secret_scan.MARGIN, secret_scan.RATE * len(m[0])) and not any(a < m.end() and m.start() < b for _, a, b in base):
                more.append(("markov", *m.span()))
        assert all_ == sorted(base + more, key=lambda s: (s[1], order.index(s[0]))), i
