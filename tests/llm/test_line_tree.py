"""The template tree against a plain one that holds every text's tokens."""

import collections
import random
import re

import pytest

from quillspark.llm import line_templates
from quillspark.llm.queries import op1_line_dedup


def brute(rows, lead=3, min_docs=3, constant=0.7, min_tokens=6, min_copies=2):
    """{row number: text without its recurring lines}; rows: (id, text)."""
    first = {}
    for i, t in rows:
        if t is not None:
            known = first.get(t, (True, 0))
            first[t] = min(known, (i is None, i or 0))
    order = sorted(first, key=lambda t: first[t])  # ids of different texts differ here
    place = {t: k for k, t in enumerate(order)}
    have = collections.defaultdict(set)
    lines = []
    for t in order:
        for at, line in enumerate(t.split("\n")):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
            if not w:
                continue
            m = ["<*>" if re.search("[0-9]", x) else x for x in w]
            han = len(re.findall(r"[一-鿿぀-ヿ]", "".join(w)))
            leaf = (len(m), *m[:lead])
            lines.append((t, at, tuple(w), m, leaf, len(w) + max(han - 1, 0)))
            if len(w) >= min_tokens:
                for k, x in enumerate(m):
                    have[leaf, k, x].add(t)
    owners = collections.defaultdict(set)
    marks = []
    for t, at, w, m, leaf, units in lines:
        if units < 2:
            continue
        owners["v", w].add(t)
        marks.append((t, at, ("v", w), min_copies))
        if len(w) >= min_tokens:
            keep = [x if x != "<*>" and len(have[leaf, k, x]) >= min_docs else "<*>" for k, x in enumerate(m)]
            fixed = sum(x != "<*>" for x in keep)
            if fixed >= lead and fixed >= constant * sum(x != "<*>" for x in m):
                owners["t", leaf, tuple(keep)].add(t)
                marks.append((t, at, ("t", leaf, tuple(keep)), min_docs))
    gone = collections.defaultdict(set)
    for t, at, key, least in marks:
        if len(owners[key]) >= least and t != min(owners[key], key=place.get):
            gone[t].add(at)
    return {n: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[t]) for n, (_, t) in enumerate(rows)}


def compared(spark, rows, **options):
    df = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n int, doc_id long, text string").repartition(3)
    got = {r["n"]: (r["line_dedup"]["text"], r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"]) for r in line_templates.drop_recurring_lines(df, **options).collect()}
    want = brute(rows, **options)
    for n, (_, t) in enumerate(rows):
        assert got[n][:2] == (want[n], t), n
        assert t is None or t == "" or want[n] == "" or got[n][2] - got[n][3] == len(want[n].split("\n"))
    return want


def test_support_counts_texts_not_lines(spark):
    mine = "\n".join(f"alpha beta gamma red {x} tail end" for x in ("one", "two", "three"))
    rows = [(0, mine), (1, "alpha beta gamma blue zzz tail end"), (2, "alpha beta gamma black yyy tail end")]
    assert compared(spark, rows) == {0: mine, 1: "", 2: ""}


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_tree(spark, seed):
    r = random.Random(seed)
    word = lambda k=9: r.choice(["red", "blue", "tail", "end", "no7", "x", "y", "z", "5"][:k])
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            kind = r.random()
            if kind < 0.6:
                lines.append(" ".join(["alpha", "beta", "gamma", *[word() for _ in range(r.choice([2, 3, 4]))], "done", "and", "sent", "off"]))
            elif kind < 0.8:
                lines.append(r.choice(["  Page\t3", "Page 3", "版权所有", "Contents", "", "   "]))
            else:
                lines.append(" ".join(word() for _ in range(r.randint(1, 8))))
        rows.append((i if i % 7 else None, "\n".join([f"own line {'abcdefghij'[i % 10] * (i // 10 + 1)}", *lines])))
    rows += [rows[3], (900, rows[5][1]), (901, None), (902, ""), (None, None)]
    # the first text is only defined by ids, so null ids are left to one row here
    rows = [(i if i is not None or n in (0, len(rows) - 1) else 1000 + n, t) for n, (i, t) in enumerate(rows)]
    gone = compared(spark, rows)
    assert sum(gone[n] != t for n, (_, t) in enumerate(rows)) > 10
    compared(spark, rows, lead=1, constant=0.5)


def test_long_text_and_clashing_columns(spark):
    long = "\n".join(f"{'abcdefghij'[k % 10] * (k % 97 + 1)} row {k} of a table that is long" for k in range(120_000))
    rows = [(1, long), (2, "x\n" + long[: long.index("\n")]), (3, None)]
    names = ["k1", "k2", "i", "row", "none", "clean", "places", "leaf", "first", "line_dedup", "r.a", "n_lines"]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    out = line_templates.drop_recurring_lines(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[2][c] for c in names if c != "line_dedup"] == [k for k, c in enumerate(names) if c != "line_dedup"]
    assert got[1]["text"] == got[1]["line_dedup"]["text"] == long and got[2]["line_dedup"]["text"] == "x" and got[3]["line_dedup"]["text"] is None


def test_query_over_its_table(spark, sf):
    import hashlib

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r["doc_id"]: r for r in op1_line_dedup(spark, sf).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        assert got[i]["kept_sha256"] == (None if t is None else hashlib.sha256(want[n].encode()).hexdigest()), i
