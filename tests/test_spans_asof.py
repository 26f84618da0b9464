import random

import pytest

from quillspark.operators import asof, spans

CASES = [
    ("longest", False, [(0, 5), (3, 8), (7, 12), (10, 15), (20, 25)], [(0, 5), (20, 25)]),
    ("longest", False, [(0, 3), (2, 8)], [(2, 8)]),
    ("longest", True, [(0, 5), (4, 7), (6, 10)], [(0, 5), (6, 10)]),
    ("longest", False, [(0, 0), (0, 5)], [(0, 0), (0, 5)]),
    ("longest", False, [(-5, -2), (-3, 0)], [(-5, -2)]),
    ("earliest", False, [(0, 5), (4, 7), (6, 10)], [(0, 5)]),
    ("earliest", True, [(0, 5), (4, 7), (6, 10)], [(0, 5), (6, 10)]),
    ("earliest", False, [(0, 3), (3, 6), (6, 9)], [(0, 3), (3, 6), (6, 9)]),
    ("earliest_longest", False, [(0, 3), (0, 5), (2, 4)], [(0, 5)]),
]


def frame(spark, groups):
    return spark.createDataFrame([(k, i, a, b) for k, g in enumerate(groups) for i, (a, b) in enumerate(g)], "k int, ord int, start int, end int")


@pytest.mark.parametrize("strategy, direct, given, expected", CASES)
def test_goldens(spark, strategy, direct, given, expected):
    rows = spans.resolve(frame(spark, [given]), ["k"], strategy, direct).orderBy("start", "end").collect()
    assert [(r["start"], r["end"]) for r in rows] == expected


def fold(given, strategy, direct):
    order = sorted(enumerate(given), key=lambda x: (x[1][0], -x[1][1] if strategy == "earliest_longest" else 0, x[0]))
    kept, reach, best, end = [], -1, None, None
    for i, (a, b) in order:
        if strategy == "longest":
            if best is None or a >= end:
                best = (i, a, b)
                kept.append(i)
                end = b
            else:
                if b - a > best[2] - best[1]:
                    best = (i, a, b)
                    kept[-1] = i
                    end = b if direct else max(end, b)
                elif not direct:
                    end = max(end, b)
        elif a >= reach:
            kept.append(i)
            reach = b if direct else max(reach, b)
        elif not direct:
            reach = max(reach, b)
    return sorted(kept)


@pytest.mark.parametrize("strategy", spans.STRATEGIES)
@pytest.mark.parametrize("direct", [True, False])
def test_random_spans_match_a_plain_fold(spark, strategy, direct):
    r = random.Random(1)
    groups = [[(a := r.randint(0, 30), a + r.randint(1, 8)) for _ in range(r.randint(1, 12))] for _ in range(60)]
    got = spans.resolve(frame(spark, groups), ["k"], strategy, direct).toPandas().groupby("k")["ord"].apply(sorted).to_dict()
    assert got == {k: fold(g, strategy, direct) for k, g in enumerate(groups)}


def test_empty_and_unknown(spark):
    assert spans.resolve(frame(spark, [[]]), ["k"]).count() == 0
    with pytest.raises(ValueError):
        spans.resolve(frame(spark, [[(0, 1)]]), ["k"], "shortest")


def test_asof(spark):
    right = spark.createDataFrame([(0, float(i), v) for i, v in zip((1, 2, 3, 4), "abcd")], "g int, k double, v string")
    left = spark.createDataFrame([(0, x) for x in (0.5, 1.0, 2.0, 2.5, 4.0, 5.0)], "g int, k double")
    expected = {"floor": [None, "a", "b", "b", "d", "d"], "ceiling": ["a", "a", "b", "c", "d", None], "lower": [None, None, "a", "b", "c", "d"], "higher": ["a", "b", "c", "c", None, None]}
    for how, values in expected.items():
        rows = asof.asof_join(left, right, on="k", by=["g"], direction=how).orderBy("k").collect()
        assert [r["r_v"] for r in rows] == values, how


def test_asof_last_of_equal_keys_wins_and_empty_right(spark):
    right = spark.createDataFrame([(0, 1, "a", 1), (0, 1, "b", 2)], "g int, k int, v string, t int")
    left = spark.createDataFrame([(0, 1)], "g int, k int")
    for how in ("floor", "ceiling"):
        assert asof.asof_join(left, right, on="k", by=["g"], direction=how, tie="t").first()["r_v"] == "b"
    assert asof.asof_join(left, right.limit(0), on="k", by=["g"]).first()["r_v"] is None


def test_range_join(spark):
    points = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    ranges = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.5, 4.5), (3, 18.0, 40.0)], "r int, a double, b double")
    got = {(r["r"], r["x"]) for r in asof.range_join(points, ranges, "x", "a", "b", 3.0).collect()}
    assert got == {(1, 2.0), (1, 3.0), (1, 4.0), (3, 18.0), (3, 19.0)}
    assert asof.range_scan(points, "x", 3.0, 5.0).count() == 2 and asof.range_scan(points, "x").count() == 20
