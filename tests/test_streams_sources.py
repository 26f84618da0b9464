import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.graph import Graph, levels
from quillspark.plans.tasks import TaskFlow
from quillspark.sources import files, mock, stores
from quillspark.streaming import enrich, limits, windows


def test_bucket_admits_capacity_then_rate():
    now = [0.0]
    b = limits.TokenBucket(4, 2, 1.0, clock=lambda: now[0])
    assert [b.acquire() for _ in range(5)] == [True] * 4 + [False]
    now[0] = 1.0
    assert [b.acquire() for _ in range(3)] == [True, True, False]


def test_cache_ages():
    now, calls = [0.0], []
    f = limits.ttl_cache(10, 0, clock=lambda: now[0])(lambda a, b: calls.append((a, b)) or len(calls))
    assert f(1, 2) == f(1, 2) == 1 and f(2, 1) == 2
    now[0] = 11
    assert f(1, 2) == 3
    f.cache_clear()
    assert f(1, 2) == 4


def test_enrich_maps_retries_times_out_and_drops(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")

    def call(r):
        if r["x"] == 2:
            raise enrich.Retryable(404)
        if r["x"] == 3:
            time.sleep(1.5)
        return None if r["x"] == 4 else r["x"] * 2

    out = {r["x"]: (r["result"], r["error"]) for r in enrich.enrich(df, call, T.IntegerType(), timeout=0.5).collect()}
    assert out == {1: (2, None), 2: (None, "Retryable: status 404"), 3: (None, "timeout")}
    assert enrich.drop_failures(enrich.enrich(df.where("x < 3"), call, T.IntegerType())).count() == 1
    with pytest.raises(Exception, match="status 404"):
        enrich.fail_on_error(enrich.enrich(df.where("x < 3"), call, T.IntegerType())).collect()


def test_retry_policy():
    tries, waits = [], []

    def fails():
        tries.append(1)
        raise enrich.Retryable(500)

    with pytest.raises(enrich.Retryable):
        enrich.RetryPolicy(attempts=3).call(fails, waits.append)
    assert len(tries) == 4 and waits == [1.0, 2.0, 4.0]
    assert enrich.RetryPolicy(attempts=1, raise_exhausted=False).call(fails, waits.append) is None
    assert not enrich.RetryPolicy().due(1, ConnectionRefusedError()) and enrich.RetryPolicy().due(1, OSError())


def test_stream_routing_and_windows(spark, tmp_path):
    from quillspark.operators import rules

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "b", 1), ("2024-01-01 01:10:00", "a", 2)], "ts string, kind string, k int").withColumn("ts", F.to_timestamp_ntz("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    routed = rules.route(windows.watermarked(stream, "ts", "10 minutes"), [rules.Classifier.of("A", {"r": "kind=a"})])
    counts = windows.tumbling(routed, "ts", "1 hour", ["label"], [F.count(F.lit(1)).alias("n")])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("routed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["window_start"].hour, r["label"], r["n"]) for r in spark.table("routed").collect()) == [(0, "A", 1), (0, "unknown", 1), (1, "A", 1)]
    admitted = limits.limit_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), "k", "ts", 1, 1, 3600.0)
    q = admitted.writeStream.outputMode("append").format("memory").queryName("admitted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["admitted"]) for r in spark.table("admitted").collect()) == [(1, False), (1, True), (2, True)]


def test_batch_windows(spark):
    rows = spark.createDataFrame([(1, f"2024-01-01 00:{m:02}:00") for m in (0, 5, 9, 40)], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    n = [F.count(F.lit(1)).alias("n")]
    assert sorted(r["n"] for r in windows.sessions(rows, "ts", "10 minutes", ["k"], n).collect()) == [1, 3]
    assert sorted(r["n"] for r in windows.bounded_sessions(rows, "ts", 600, 480, ["k"]).collect()) == [1, 1, 2]
    assert windows.sliding(rows, "ts", "20 minutes", "10 minutes", ["k"], n).count() == 4


def test_graph(spark):
    g = Graph([("a", "c"), ("b", "c"), ("c", "d"), ("a", "c")])
    assert g.order() == ["a", "b", "c", "d"] and sorted(g.edges()) == [("a", "c"), ("b", "c"), ("c", "d")] and not g.has_cycle()
    assert g.predecessors("c") == ["a", "b"] and g.successors("c") == ["d"] and g.neighbors("c") == ["d", "a", "b"] and g.has_edge("a", "c") and not g.has_edge("c", "a")
    assert Graph([(1, 2), (2, 1)]).has_cycle() and not Graph().has_cycle()
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        levels(spark.createDataFrame([("a",), ("b",)], "vertex string"), edges)


def test_task_flow():
    flow = TaskFlow()
    flow.add("a", lambda r: 1)
    flow.add("b", lambda r: 2)
    flow.add("c", lambda r: r["a"] + r["b"], ("a", "b"))
    flow.add("d", lambda r: r["c"] * 10, ("c",))
    assert flow.run()["d"] == 30
    with pytest.raises(ValueError):
        flow.add("a", lambda r: 1)
    with pytest.raises(ValueError, match="undefined"):
        bad = TaskFlow()
        bad.add("x", lambda r: 1, ("y",))
        bad.run()
    with pytest.raises(ZeroDivisionError):
        failing = TaskFlow()
        failing.add("x", lambda r: 1 / 0)
        failing.run()


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("héllo")
    (tmp_path / "d/b.txt").write_bytes(b"\xff\xfe\xff")
    assert [r["text"] for r in files.texts(spark, str(tmp_path / "d")).collect()] == ["héllo"]
    assert files.listing(spark, str(tmp_path / "d")).count() == 2 and files.folders(spark, str(tmp_path)).count() == 1
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(RuntimeError):
        files.resource_json(tmp_path / "bad.json")
    df = spark.createDataFrame([(1, "x,y")], "a int, b string")
    assert [files.render_rows(df, how).first()[0] for how in ("json", "csv", "sep(|)", "{{b}}={{a}}")] == ['{"a":1,"b":"x,y"}', '1,"x,y"', "1|x,y", "x,y=1"]
    files.write_xml(df, str(tmp_path / "x"), "rows", "row")
    assert files.xml_rows(spark, str(tmp_path / "x"), "row", "a int, b string").first()["b"] == "x,y"


def test_paged_source(spark):
    pages = {("k1", None): ([{"id": 1}], "t"), ("k1", "t"): ([{"id": 2}], None), ("k2", None): ([{"id": 3}], None)}
    df = stores.read_paged(spark, "pages_of_test", T.StructType([T.StructField("id", T.LongType())]), lambda k, t: pages[k, t], ["k1", "k2"])
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]


def test_mock_rows_are_stable(spark):
    spec = {"name": "str(3,8)", "age": "num(18,65)", "maybe": {"value": "num(0,1)", "null": 0.5}, "tags": {"type": "array", "items": "enum(a,b)", "size": 2}}
    a, b = mock.rows(spark, spec, 200).collect(), mock.rows(spark, spec, 200).repartition(7).collect()
    assert sorted(a, key=str) == sorted(b, key=str) and 50 < sum(r["maybe"] is None for r in a) < 150 and len(a[0]["tags"]) == 2


def test_cached_calls_run_outside_the_lock():
    import threading
    from concurrent.futures import ThreadPoolExecutor

    from quillspark.streaming.limits import ttl_cache

    @ttl_cache(60)
    def factorial(n):
        return n * factorial(n - 1) if n else 1

    assert factorial(20) == 2432902008176640000
    both = threading.Barrier(2, timeout=10)

    @ttl_cache(60)
    def met(n):
        both.wait()
        return n

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(met, [1, 2])) == [1, 2]
    assert met(1) == 1
