"""The registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import collections as coll
from quillspark.functions import dates, numbers, text
from quillspark.operators import asof, rules, spans, where
from quillspark.plans.registry import register
from quillspark.session import table
from quillspark.streaming import windows

ROUTES = {"hot": {"active": "nonnull(user_id)&event_type=purchase|signup"}, "err": {"nines": 'event_type=error&regex(props,".*: 9[0-9].*")'}}
_ROUTED = """SELECT event_id, 'hot' AS label FROM events WHERE user_id IS NOT NULL AND event_type IN ('purchase','signup')
UNION ALL SELECT event_id, 'err' AS label FROM events WHERE event_type = 'error' AND regexp_full_match(props, '.*: 9[0-9].*')
UNION ALL SELECT event_id, 'unknown' AS label FROM events WHERE NOT (user_id IS NOT NULL AND event_type IN ('purchase','signup')) AND NOT (event_type = 'error' AND regexp_full_match(props, '.*: 9[0-9].*'))"""


@register("rule_route", f"SELECT label, COUNT(*) AS n FROM ({_ROUTED}) GROUP BY label")
def rule_route(spark: SparkSession, d: str) -> DataFrame:
    return rules.route(table(spark, d, "events"), rules.classifiers({k: {"rules": v} for k, v in ROUTES.items()})).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("rule_route_rows", _ROUTED)
def rule_route_rows(spark: SparkSession, d: str) -> DataFrame:
    return rules.route(table(spark, d, "events"), rules.classifiers({k: {"rules": v} for k, v in ROUTES.items()})).select("event_id", "label")


@register("rule_equals_numeric", "SELECT event_id, user_id FROM events WHERE CAST(user_id AS VARCHAR) IN ('1','2','3')")
def rule_equals_numeric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(rules.parse("user_id=1|2|3").predicate).select("event_id", "user_id")


@register("rule_first_match", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'none' END AS rule FROM orders")
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    c = rules.Classifier.of("order", {"urgent": "o_orderpriority=1-URGENT|2-HIGH", "finished": "o_orderstatus=F"})
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(c.first_match, F.lit("none")).alias("rule"))


@register("rule_any_all", "SELECT o_orderkey, (o_orderstatus = 'F' OR o_totalprice IS NOT NULL) AS any_match, (o_orderstatus = 'F' AND o_totalprice IS NOT NULL) AS all_match FROM orders")
def rule_any_all(spark: SparkSession, d: str) -> DataFrame:
    c = rules.Classifier.of("order", {"a": "o_orderstatus=F", "b": "nonnull(o_totalprice)"})
    return table(spark, d, "orders").select("o_orderkey", c.any_match.alias("any_match"), c.all_match.alias("all_match"))


@register("where_nested", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey IN (1,2,3)) AND c_name IS NOT NULL")
def where_nested(spark: SparkSession, d: str) -> DataFrame:
    config = [
        {"column": "c_acctbal", "operator": "gt", "value": 0},
        {"or": [{"column": "c_mktsegment", "operator": "eq", "value": "BUILDING"}, {"column": "c_nationkey", "operator": "in", "value": [1, 2, 3]}]},
        {"column": "c_name", "operator": "is not", "value": None},
    ]
    return table(spark, d, "customer").where(where.build(config)).select("c_custkey", "c_mktsegment")


@register("where_between_like", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 AND p_brand LIKE 'Brand#1%' AND starts_with(p_name, 'red') AND p_size NOT IN (7, 9) AND p_type NOT LIKE 'ECO%'")
def where_between_like(spark: SparkSession, d: str) -> DataFrame:
    leaves = [("p_size", "between", [5, 30]), ("p_brand", "like", "Brand#1%"), ("p_name", "startswith", "red"), ("p_size", "not in", [7, 9]), ("p_type", "not like", "ECO%")]
    return table(spark, d, "part").where(where.build([dict(zip(("column", "operator", "value"), x)) for x in leaves])).select("p_partkey")


@register("where_collapsed", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND o_totalprice >= 1000 AND o_totalprice <= 100000 AND o_totalprice < 90000")
def where_collapsed(spark: SparkSession, d: str) -> DataFrame:
    leaves = [("o_orderstatus", "in", ["O"]), ("o_orderpriority", "ne", "5-LOW"), ("o_totalprice", "ge", 1000), ("o_totalprice", "le", 100000), ("o_totalprice", "lt", 90000)]
    return table(spark, d, "orders").where(where.build({"and": [dict(zip(("column", "operator", "value"), x)) for x in leaves]})).select("o_orderkey")


@register("json_get_typed", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COALESCE(json_extract_string(props, '$.missing'), 'none') AS m FROM events")
def json_get_typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("m"))


def _asof(spark: SparkSession, d: str, direction: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    left, right = e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    return asof.asof_join(left, right, on="ts", by=["user_id"], direction=direction, tie="event_id").select("event_id", "user_id", F.col("r_event_id").alias("error_id"))


def _asof_sql(compare: str) -> str:
    best = "MAX(e.ts)" if compare[0] == "<" else "MIN(e.ts)"
    return f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
b AS (SELECT p.event_id, {best} AS ts FROM p JOIN e ON p.user_id = e.user_id AND e.ts {compare} p.ts GROUP BY p.event_id)
SELECT p.event_id, p.user_id, e.event_id AS error_id FROM p LEFT JOIN b ON p.event_id = b.event_id LEFT JOIN e ON e.user_id = p.user_id AND e.ts = b.ts"""


for _name, _direction, _compare in (("asof_floor", "floor", "<="), ("asof_ceiling", "ceiling", ">="), ("asof_lower", "lower", "<"), ("asof_higher", "higher", ">")):
    register(_name, _asof_sql(_compare))(lambda s, d, k=_direction: _asof(s, d, k))


@register("range_scan", "SELECT event_id, ts FROM events WHERE ts >= (SELECT MIN(ts) + INTERVAL 1 HOUR FROM events) AND ts < (SELECT MIN(ts) + INTERVAL 3 HOUR FROM events)")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.agg(F.min("ts")).first()[0]
    return asof.range_scan(e, "ts", first + dt.timedelta(hours=1), first + dt.timedelta(hours=3)).select("event_id", "ts")


@register("range_join", "SELECT s.s_suppkey, p.p_partkey FROM supplier s JOIN part p ON p.p_retailprice >= s.s_acctbal AND p.p_retailprice < s.s_acctbal + 20")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    ranges = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_acctbal") + 20).alias("upto"))
    return asof.range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "s_acctbal", "upto", 50.0).select("s_suppkey", "p_partkey")


_SPANS = "(SELECT user_id, event_id AS ord, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 20) AS BIGINT) AS \"end\" FROM events)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), at.alias("start"), (at + F.floor(F.col("value") * 20)).alias("end"))


def _reach(order: str) -> str:
    return f'SELECT *, MAX("end") OVER (PARTITION BY user_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_SPANS} s'


def _direct(order: str, longest: bool) -> str:
    ks, ke, ko = ('CASE WHEN s.start >= c.ke OR s."end" - s.start > c.ke - c.ks THEN {} ELSE {} END' if longest else "CASE WHEN s.start >= c.ke THEN {} ELSE {} END",) * 3
    ks, ke, ko = ks.format("s.start", "c.ks"), ke.format('s."end"', "c.ke"), ko.format("s.ord", "c.ko")
    grp = "CASE WHEN s.start >= c.ke THEN c.g + 1 ELSE c.g END"
    return f"""WITH RECURSIVE s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY {order}) AS i FROM {_SPANS} q),
c(user_id, i, ks, ke, ko, g) AS (SELECT user_id, i, start, "end", ord, CAST(1 AS BIGINT) FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, {ks}, {ke}, {ko}, {grp} FROM c JOIN s ON s.user_id = c.user_id AND s.i = c.i + 1),
l AS (SELECT user_id, g, MAX(i) AS i FROM c GROUP BY user_id, g) SELECT c.user_id, c.ko AS ord FROM c JOIN l ON c.user_id = l.user_id AND c.i = l.i"""


_LONGEST = f"""WITH r AS ({_reach('start, ord')}), g AS (SELECT *, SUM(CASE WHEN start < reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS run FROM r),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, run ORDER BY start - "end", start, ord) AS rn FROM g) SELECT user_id, ord FROM k WHERE rn = 1"""
for _name, _strategy, _is_direct, _sql in (
    ("overlap_longest", "longest", False, _LONGEST),
    ("overlap_earliest", "earliest", False, f"SELECT user_id, ord FROM ({_reach('start, ord')}) WHERE start >= COALESCE(reach, -1)"),
    ("overlap_earliest_longest", "earliest_longest", False, f"SELECT user_id, ord FROM ({_reach('start, "end" DESC, ord')}) WHERE start >= COALESCE(reach, -1)"),
    ("overlap_longest_direct", "longest", True, _direct("start, ord", True)),
    ("overlap_earliest_direct", "earliest", True, _direct("start, ord", False)),
    ("overlap_earliest_longest_direct", "earliest_longest", True, _direct('start, "end" DESC, ord', False)),
):
    register(_name, _sql)(lambda s, d, k=_strategy, b=_is_direct: spans.resolve(_spans(s, d), ["user_id"], k, b).select("user_id", "ord"))


@register("sla_window", "WITH w AS (SELECT date_trunc('hour', MAX(ts) - INTERVAL 90 MINUTE) AS hi FROM events) SELECT event_type, COUNT(*) AS n FROM events, w WHERE ts >= hi - INTERVAL 6 HOUR AND ts < hi GROUP BY event_type")
def sla_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    latest = e.agg(F.max("ts").alias("latest"))
    start, end = dates.violation_window(F.col("latest"), F.lit(dt.timedelta(minutes=90)), F.lit(dt.timedelta(hours=6)))
    lo, hi = latest.select(start, end).first()
    return e.where(dates.in_window(F.col("ts"), F.lit(lo), F.lit(hi))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("sla_windows", "SELECT r_name AS system, date_trunc('hour', TIMESTAMP '2024-03-01 10:25:00' - (r_regionkey + 1) * INTERVAL 50 MINUTE) - INTERVAL 2 HOUR AS win_start, date_trunc('hour', TIMESTAMP '2024-03-01 10:25:00' - (r_regionkey + 1) * INTERVAL 50 MINUTE) AS win_end FROM region")
def sla_windows(spark: SparkSession, d: str) -> DataFrame:
    sla = F.make_dt_interval(mins=(F.col("r_regionkey") + 1) * 50)
    start, end = dates.violation_window(F.expr("timestamp_ntz'2024-03-01 10:25:00'"), sla, F.lit(dt.timedelta(hours=2)))
    return table(spark, d, "region").select(F.col("r_name").alias("system"), start.alias("win_start"), end.alias("win_end"))


@register("date_partitions", "SELECT strftime(unnest(generate_series(CAST(CAST(MIN(o_orderdate) AS DATE) AS TIMESTAMP), CAST(CAST(MAX(o_orderdate) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)), '%Y-%m-%d') AS date FROM orders")
def date_partitions(spark: SparkSession, d: str) -> DataFrame:
    return dates.dates_between(table(spark, d, "orders"), F.col("o_orderdate"), F.col("o_orderdate")).select(F.col("date").cast("string").alias("date"))


@register("tumbling_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_hourly(spark: SparkSession, d: str) -> DataFrame:
    e = windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    return e.select(F.col("window_start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, MIN(ts) AS window_start, MAX(ts) + INTERVAL 30 MINUTE AS window_end, COUNT(*) AS n FROM s GROUP BY user_id, k"""


def _sessions(e: DataFrame) -> DataFrame:
    e = windows.sessions(e, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return e.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n")


@register("session_windows", _SESSIONS)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(table(spark, d, "events"))


@register("stats", "SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS avg_q, MEDIAN(l_quantity) AS median_q, MIN(l_quantity) AS min_q, MAX(l_quantity) AS max_q, ROUND(COALESCE(STDDEV_SAMP(l_quantity), 0), 6) AS sd_q FROM lineitem GROUP BY l_returnflag")
def stats(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(q), 6).alias("avg_q"), F.median(q).alias("median_q"), F.min(q).alias("min_q"), F.max(q).alias("max_q"), F.round(F.coalesce(F.stddev_samp(q), F.lit(0.0)), 6).alias("sd_q"))


@register("group_lists", "SELECT o_custkey, MIN(o_orderkey) AS first, array_to_string(list(o_orderstatus ORDER BY o_orderkey), ',') AS statuses FROM orders GROUP BY o_custkey")
def group_lists(spark: SparkSession, d: str) -> DataFrame:
    return coll.group_lists(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey").select("o_custkey", "first", F.array_join("values", ",").alias("statuses"))


@register("invert_map", "SELECT o_orderpriority AS v, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS keys FROM orders GROUP BY o_orderpriority")
def invert_map(spark: SparkSession, d: str) -> DataFrame:
    maps = table(spark, d, "orders").select(F.create_map("o_orderstatus", "o_orderpriority").alias("m"))
    return coll.invert_map(maps, "m").select("v", F.array_join("keys", ",").alias("keys"))


_ATTRIBUTES = "SELECT user_id, event_type, array_to_string(list_sort(list(DISTINCT CAST(floor(value) AS BIGINT))), ',') AS vals FROM events GROUP BY user_id, event_type"


def _attributes(e: DataFrame) -> DataFrame:
    e = e.withColumn("v", F.floor("value"))
    return coll.attribute_sets(e, ["user_id"], "event_type", "v").select("user_id", F.explode("attrs").alias("event_type", "vals")).select("user_id", "event_type", F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals"))


@register("attribute_sets", _ATTRIBUTES)
def attribute_sets(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(table(spark, d, "events"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    entries = F.array(F.struct(F.lit("tag").alias("n"), F.col("lang").alias("k")), F.struct(F.lit("tag").alias("n"), F.col("source").alias("k")))
    return docs.select("doc_id", F.explode(entries).alias("e")).select(F.col("e.n").alias("index_name"), F.col("e.k").alias("key"), "doc_id").distinct()


@register("postings_and", "SELECT doc_id FROM (SELECT doc_id, lang AS k FROM documents UNION SELECT doc_id, source FROM documents) WHERE k IN ('en', 'src0') GROUP BY doc_id HAVING COUNT(DISTINCT k) = 2")
def postings_and(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.operators.search import by_all

    return by_all(_index(spark, d), "tag", ["en", "src0"])


@register("postings_or", "SELECT DISTINCT doc_id FROM (SELECT doc_id, lang AS k FROM documents UNION SELECT doc_id, source FROM documents) WHERE k IN ('fr', 'src1')")
def postings_or(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.operators.search import by_any

    return by_any(_index(spark, d), "tag", ["fr", "src1"])


@register("posting_sizes", "SELECT k AS key, COUNT(DISTINCT doc_id) AS n FROM (SELECT doc_id, lang AS k FROM documents UNION SELECT doc_id, source FROM documents) GROUP BY k")
def posting_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@register("anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@register("lookup_default", "SELECT n.n_nationkey, COALESCE(r.r_name, n.n_name) AS full_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").where("r_name <> 'ASIA'")
    n = table(spark, d, "nation")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("n_nationkey", F.coalesce("r_name", "n_name").alias("full_name"))


@register("lookup_inner", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@register("top1_rank", "SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderpriority = '1-URGENT', o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def top1_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "F").asc(), (F.col("o_orderpriority") == "1-URGENT").asc(), F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey")


@register("confidence", "SELECT o_custkey, COUNT(*) AS total, round_even(1.0 / COUNT(*), 2) AS confidence FROM orders GROUP BY o_custkey")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.operators.search import confidence as of

    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total")).select("o_custkey", "total", of(F.col("total").cast("double"), 2).alias("confidence"))


@register("ascii_fold", "SELECT doc_id, md5(translate(text, '（），：', '(),:')) AS folded FROM documents")
def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.to_ascii(F.col("text")).cast("binary")).alias("folded"))


@register("ws_remove", r"SELECT doc_id, length(regexp_replace(text, '[\s\x1c-\x1f\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS n FROM documents")
def ws_remove(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.remove_whitespace(F.col("text"))).cast("long").alias("n"))


@register("split_variants", "SELECT doc_id, len(regexp_split_to_array(text, '[,，、]')) AS n_parts FROM documents")
def split_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.split_equivalents(F.col("text"), ",")).cast("long").alias("n_parts"))


@register("strip_variants", "SELECT doc_id, length(trim(text, '.．')) AS n FROM documents")
def strip_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.strip_equivalents(F.col("text"), ".")).cast("long").alias("n"))


@register("sentence_free", "SELECT doc_id, NOT regexp_matches(text, '[?!.。？！]') AS free FROM documents")
def sentence_free(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.free_of_sentence_end(F.col("text"), F.lit(0), F.length("text")).alias("free"))


@register("regex_spans", """WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{4}') AS ms, regexp_split_to_array(text, '[0-9]{4}') AS ps FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM m WHERE len(ms) > 0)
SELECT doc_id, ms[i] AS span, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + 4 * (i - 1) AS BIGINT) AS start FROM u""")
def regex_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").rlike("[0-9]{4}"))
    return docs.select("doc_id", F.explode(text.match_spans(F.col("text"), "[0-9]{4}")).alias("s")).select("doc_id", F.col("s.text").alias("span"), F.col("s.start").cast("long").alias("start"))


@register("epoch_dates", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - 28800 AS e, strftime(o_orderdate, '%Y%m') AS ym FROM orders")
def epoch_dates(spark: SparkSession, d: str) -> DataFrame:
    e = dates.epoch_at_offset(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", e.alias("e"), F.get(dates.date_keys(e), F.lit(1)).alias("ym"))


@register("hour_offset", "SELECT event_id, date_trunc('hour', ts) + INTERVAL 15 MINUTE AS t FROM events")
def hour_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.hour_floor(F.col("ts"), dt.timedelta(minutes=15)).alias("t"))


@register("backoff", "SELECT r_regionkey, CAST(0.5 * pow(2, r_regionkey) * 1000 AS BIGINT) AS ms, (r_regionkey <= 3 AND 500 IN (429,500,502,503,504)) AS due FROM region")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("r_regionkey")
    return table(spark, d, "region").select(a, numbers.backoff_ms(a).alias("ms"), numbers.retryable(a, F.lit(500)).alias("due"))


@register("error_count", "SELECT COUNT(*) FILTER (WHERE event_type = 'error') AS num_records_error, COUNT(*) AS n FROM events")
def error_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("num_records_error"), F.count(F.lit(1)).alias("n"))


@register("partition_lists", "SELECT o_custkey, len(list_filter(list(o_totalprice), lambda x: x > 50000)) AS big, len(list_filter(list(o_totalprice), lambda x: NOT x > 50000)) AS small FROM orders GROUP BY o_custkey")
def partition_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("p"))
    kept, removed = coll.partition(F.col("p"), lambda x: x > 50000)
    return lists.select("o_custkey", F.size(removed).cast("long").alias("big"), F.size(kept).cast("long").alias("small"))


@register("json_rows", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS j FROM region")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_regionkey", coll.to_json("r_regionkey", "r_name").alias("j"))


@register("template_rows", "SELECT 'nation ' || n_name || ' (' || n_nationkey || ')' AS value FROM nation")
def template_rows(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.sources.files import render_rows

    return render_rows(table(spark, d, "nation"), "nation {{n_name}} ({{n_nationkey}})")


@register("plain_number", "SELECT o_orderkey, CAST(CAST(round_even(o_totalprice, 0) AS BIGINT) AS VARCHAR) AS p FROM orders")
def plain_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.plain_number(F.col("o_totalprice")).alias("p"))


@register("similar_names", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 5")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return pairs.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").cast("long").alias("distance")).where("distance <= 5")
