"""The pipeline's near-dedup stage on planted near copies, against brute force."""

import random

import corpus_pipeline as pipeline
from quillspark.llm import near_copies


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def planted():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for k in range(40):
        words = [word() for _ in range(r.choice([60, 200, 400]))]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for at in r.sample(range(len(words)), k % 8 * len(words) // 200 + 1):
                other[at] = word()
            texts.append(" ".join(other))
    return [*texts, None, "", texts[0].upper(), "one two", "One  two"]


def test_planted_near_copies(spark, sf):
    texts = planted()
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= 0.8 or not (texts[i] or texts[j])]
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert 40 < len(pairs) < 120 and any(jaccard(texts[i], texts[j]) < 0.85 for i, j in pairs if texts[i])
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = texts[1].split()
    lone = [(None, " ".join(near[:-1]), "en", "s", 1), (None, "x y z " + texts[3], "en", "s", 1)]
    df = df.union(spark.createDataFrame(lone, df.schema))  # near copies without an id
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, df, sf).collect()) == sorted(set(root))


def test_joined_compares_all_pairs():
    import numpy as np

    base = np.arange(100, dtype=np.uint64)
    sets = [base, base + np.uint64(10), base + np.uint64(20), base + np.uint64(1000), base[:79], np.zeros(0, np.uint64)]
    assert near_copies.joined(sets, 0.8, [0] * 6) == [(0, 1), (1, 2)]
    assert near_copies.joined(sets, 0.8, [0, 1, 1, 0, 1, 0]) == [(0, 1)]


def test_components_in_tiles(spark):
    """Chains of near copies: only neighbours reach the bound, and a tile holds a few of them."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(1200)]
    rows = [(100 * c + i, " ".join(words[300 * c + 8 * i : 300 * c + 8 * i + 100])) for c in range(4) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0], (None, None)], "doc_id long, _text string")
    for tile in (1024, 3):
        got = near_copies.classes(df.withColumnRenamed("_text", "text").withColumn("k", df["doc_id"]).na.fill(-1, ["k"]), ["k"], ["doc_id"], tile=tile).collect()
        of = {}
        for x in got:
            of.setdefault(x["class"], set()).add(x["doc_id"])
        assert len(got) == 50 and sorted(map(sorted, (v for v in of.values() if None not in v))) == [[100 * c + i for i in range(12)] for c in range(4)]


def test_fingerprints_are_operator_8s():
    import numpy as np
    from quillspark.llm import simhash

    r = random.Random(5)
    for n in (1, 4, 5, 6, 300, 700):
        text = " ".join(str(r.getrandbits(60)) for _ in range(n))
        fp = near_copies.fingerprint(near_copies.shingles(text, 5))
        assert int(fp[0]) == simhash.fingerprint(text, 5) and len(set(fp.tolist())) == near_copies.WORDS
    assert not near_copies.fingerprint(np.zeros(0, np.uint64)).any()


def test_candidates_are_all_close_fingerprints(spark):
    """The components of the candidates against all pairs of fingerprints, and no pair at the bound is missed."""
    import numpy as np
    from quillspark.llm import simhash

    rng = np.random.default_rng(7)
    sets = []
    for n in (1, 2, 4, 5, 5, 8, 9, 9, 16, 90, 300):
        for _ in range(12):
            base = np.unique(rng.integers(0, 2**63, n + n // 4 + 1).astype(np.uint64))
            sets += [base[:n], base[: n + n // 4], np.sort(rng.permutation(base)[:n])]
    sets = [np.array(s, np.uint64) for s in {tuple(s.tolist()) for s in sets}]
    fps = [near_copies.fingerprint(s) for s in sets]
    root, links = list(range(len(sets))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            small, large = sorted((len(a), len(b)))
            most = small - (small == large)
            both = len(np.intersect1d(a, b))
            close = np.bitwise_count(fps[i] ^ fps[j]).sum() <= near_copies.RADIUS and 10 * most >= 8 * (small + large - most)
            if 10 * both >= 8 * (len(a) + len(b) - both):
                links += 1
                assert close
            if close:
                x, y = root[i], root[j]
                root = [min(x, y) if z in (x, y) else z for z in root]
    assert links > 50 and len(set(root)) > 100
    nodes = spark.createDataFrame([(i, len(s), f.view(np.int64).tolist()) for i, (s, f) in enumerate(zip(sets, fps))], "node long, size int, fp array<long>")
    for tile in (near_copies.FP_TILE, 5):
        got = {r["node"]: r["root"] for r in simhash.components(near_copies.candidates(nodes, 0.8, near_copies.RADIUS, tile)).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == root
