"""Registered queries over inline rows: the SQL twin is the table of expected rows. Text in ``documents`` has no such entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text, xml
from quillspark.functions.numbers import numerals
from quillspark.operators import extract, graph, resolve, search, titles
from quillspark.plans.registry import register
from quillspark.session import table
from quillspark.sources import mock
from quillspark.streaming import enrich as enrichment
from quillspark.streaming import limits


def values(columns: str, *rows: tuple) -> str:
    """SQL for inline rows."""
    put = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) t({columns})"


PAIRED = [
    ("all", "A《X》B《Y》C", extract.paired("《", "》"), [("X", 2, 3), ("Y", 6, 7)]),
    ("innermost", "《A《B》C》", extract.paired("《", "》", strategy="innermost"), [("B", 3, 4)]),
    ("outermost", "《A《B》C》", extract.paired("《", "》", strategy="outermost"), [("A《B》C", 1, 6)]),
    ("include", "(a) and (b)", extract.paired("(", ")", include=True), [("(a)", 0, 3), ("(b)", 8, 11)]),
    ("fallback", "[ A [B [C] D] E", extract.paired("[", "]", strategy="outermost", fallback=True), [("B [C] D", 5, 12)]),
    ("two groups", "[ [ [inner] ] [ [other] ]", extract.paired("[", "]", strategy="outermost", fallback=True), [(" [inner] ", 3, 12), (" [other] ", 15, 24)]),
    ("stray", "} {a} } {b{c}d} } {e} }", extract.paired("{", "}", strategy="innermost"), [("a", 3, 4), ("c", 11, 12), ("e", 19, 20)]),
]
KEYED = [
    ("overlapping", "hello", extract.keywords(["he", "hello", "lo"]), [("he", 0, 2), ("hello", 0, 5), ("lo", 3, 5)]),
    ("longest", "abcd", extract.keywords(["ab", "bc", "abc", "bcd"], ignore_overlaps=True), [("abc", 0, 3)]),
    ("chained", "开始《法律（条款123）内容》结束", extract.Chain([extract.paired("《", "》")], [extract.paired("（", "）")], [extract.pattern(r"\d+")]), [("123", 8, 11)]),
]


def _cases(spark: SparkSession, cases: list) -> DataFrame:
    out = None
    for name, t, extractor, _ in cases:
        df = spark.createDataFrame([(name, t)], "case_id string, text string")
        df = extract.explode_spans(df, extractor).select("case_id", "ord", "span_text", "start", "end")
        out = df if out is None else out.unionByName(df)
    return out


def _expected(cases: list) -> str:
    return values('case_id, ord, span_text, start, "end"', *[(n, i, *s) for n, _, _, spans in cases for i, s in enumerate(spans)])


@register("paired_spans", _expected(PAIRED))
def paired_spans(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, PAIRED)


@register("keyword_spans", _expected(KEYED))
def keyword_spans(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, KEYED)


@register("bracket_spans", """WITH m AS (SELECT doc_id, regexp_extract_all(text, '\\([^()]*\\)') AS ms, regexp_split_to_array(text, '\\([^()]*\\)') AS ps FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM m WHERE len(ms) > 0)
SELECT doc_id, ms[i] AS span_text, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM u""")
def bracket_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\(")).select("doc_id", "text")
    return extract.explode_spans(docs, extract.paired("(", ")", include=True, strategy="innermost")).select("doc_id", "span_text", F.col("start").cast("long").alias("start"))


@register("link_spans")
def link_spans(spark: SparkSession, d: str) -> DataFrame:
    """Link spans of whole pages; ``<a`` also begins other tags, and unclosed ones fall back to inner pairs."""
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    return extract.explode_spans(pages, extract.paired("<a", "</a>", strategy="outermost", fallback=True))


TITLES = [
    ("中华人民共和国民法典(2020年)", "民法典"), ("最高人民法院关于适用《中华人民共和国公司法》若干问题的规定(一)", "公司法"), ("转发民法典", "转发民法典"), ("中华人民共和国(2020年), 民法典", "民法典"),
    ("中华人民共和国((2020年))民法典", "民法典"), ("中华人民共和国民法典(2020年", "民法典(2020年"), ("(民法典)", "(民法典)"), ("民法典()", "民法典"), ("()民法典", "()民法典"),
]
NAMES = ("中华人民共和国", "最高人民法院")


@register("title_core", values("title, core", *TITLES))
def title_core(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(t,) for t, _ in TITLES], "title string")
    return df.select("title", titles.core_term(F.col("title"), NAMES).alias("core"))


@register("title_tokens", values("title, core, prefixes, suffixes, nested", ("中华人民共和国民法典(2020年)", "民法典", "中华人民共和国", "(2020年)", "false"), ("最高人民法院关于适用《中华人民共和国公司法》若干问题的规定(一)", "公司法", "最高人民法院,中华人民共和国", "(一)", "true")))
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(t,) for t, _ in TITLES[:2]], "title string").withColumn("t", titles.tokens(F.col("title"), titles.TitleTokenizer(NAMES, nested=True)))
    texts = lambda c: F.array_join(F.transform(F.col("t")[c], lambda s: s["text"]), ",")
    return df.select("title", F.col("t.core_term").alias("core"), texts("prefixes").alias("prefixes"), texts("suffixes").alias("suffixes"), F.col("t.nested").cast("string").alias("nested"))


LAWS = [
    ("law_001", "深圳证券交易所章程", ["中国人民银行深圳分行"], "广东省", "已被修改", 662659200, ""),
    ("law_002", "中国注册会计师协会关于印发《中国注册会计师协会章程》的通知", ["中国注册会计师协会"], "全国", "现行有效", 837100800, "会协(1996)321号"),
    ("law_003", "上海证券交易所章程", ["上海证券交易所"], "全国", "失效", 922896000, "上证字(1999)7号"),
    ("law_004", "关于发布《上海证券交易所章程》的通知", ["上海证券交易所", "其他机构"], "全国", "失效", 1478793600, "上证发(2016)69号"),
    ("law_005", "深圳证券交易所关于发布《深圳证券交易所章程》的通知（2018）", ["中国人民银行深圳分行"], "广东省", "现行有效", 1531958400, "深证会[2018]271号"),
    ("law_006", "深圳证券交易所章程", ["中国人民银行深圳分行"], "广东省", "现行有效", 1531958400, "深证会[2018]271号"),
]


def doc_meta(spark: SparkSession) -> DataFrame:
    rows = [(i, "Legislation", None, t, "章程", 1, None, None, release, version, None, False, names, status, scope, None, None, None) for i, t, names, scope, status, release, version in LAWS]
    return spark.createDataFrame(rows, search.DOC_META)


@register("search_best", values("query_id, confidence, doc_id, total", ("abbr", 0.0, None, 0), ("dated", 0.0, None, 0), ("plain", 0.5, "law_006", 2), ("shanghai", 0.5, "law_004", 2)))
def search_best(spark: SparkSession, d: str) -> DataFrame:
    own = ("cur", "Legislation", 1700000000)
    rows = [("plain", "深圳证券交易所章程", "LAW_TITLE", {}, *own), ("dated", "深圳证券交易所章程", "LAW_TITLE", {"DATE": ["2018年"]}, *own), ("shanghai", "上海证券交易所章程", "LAW_TITLE", {}, *own), ("abbr", "公司法", "LAW_ABBR", {}, *own)]
    asked = spark.createDataFrame(rows, "query_id string, text string, type string, attrs map<string,array<string>>, cur_doc_id string, cur_doc_type string, cur_release_date long")
    return search.search_best(asked, doc_meta(spark))


CASE_TEXT = "根据（2025）沪0101刑初第682号、第683号"


@register("case_numbers", values('text, start, "end", alias', ("（2025）沪0101刑初第682号", 2, 20, "（2025）沪0101刑初第682号"), ("第683号", 21, 26, "（2025）沪0101刑初第683号")))
def case_numbers(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(1, CASE_TEXT, "Case")], "doc_id int, text string, doc_type string")
    return extract.extract_entities(df).where("type = 'CASE_NO'").select(F.col("ent_text").alias("text"), "start", "end", "alias")


LINKED = [
    (1, "Law Title (2023)", [("Law Title", 0, 9, "LAW_TITLE"), ("2023", 11, 15, "DATE")]),
    (2, "2023 Law Title", [("2023", 0, 4, "DATE"), ("Law Title", 5, 14, "LAW_TITLE")]),
    (3, "Law Title. 2023", [("Law Title", 0, 9, "LAW_TITLE"), ("2023", 11, 15, "DATE")]),
    (4, "Law Title 2023", [("Law Title", 0, 9, "LAW_TITLE"), ("2023", 10, 14, "DATE")]),
    (5, "Law Title Article 1", [("Law Title", 0, 9, "LAW_TITLE"), ("Article 1", 10, 19, "LAW_ARTICLE")]),
    (6, "Law Title. Article 1", [("Law Title", 0, 9, "LAW_TITLE"), ("Article 1", 11, 20, "LAW_ARTICLE")]),
]


@register("entity_resolve", values("doc_id, ent_id, type, refers_to, dates", (1, 0, "LAW_TITLE", None, "2023"), (2, 1, "LAW_TITLE", None, "2023"), (3, 0, "LAW_TITLE", None, None), (4, 0, "LAW_TITLE", None, None), (5, 0, "LAW_TITLE", None, None), (5, 1, "LAW_ARTICLE", 0, None), (6, 0, "LAW_TITLE", None, None)))
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([(i, t, "Practice", "") for i, t, _ in LINKED], "doc_id int, text string, doc_type string, title string")
    rows = [(i, k, *e, None, None, None) for i, _, es in LINKED for k, e in enumerate(es)]
    found = spark.createDataFrame(rows, "doc_id int, ent_id int, ent_text string, start int, end int, type string, alias string, def_start int, def_end int")
    return resolve.resolve(docs, found).select("doc_id", "ent_id", "type", "refers_to", F.array_join(F.try_element_at("attrs", F.lit("DATE")), ",").alias("dates"))


@register("numerals", values("s, n", ("一", 1), ("十", 10), ("十二", 12), ("二十", 20), ("一百零五", 105), ("一千二百三十四", 1234), ("三万", 30000), ("12", 12), ("条", None)))
def numerals_(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(s,) for s in ("一", "十", "十二", "二十", "一百零五", "一千二百三十四", "三万", "12", "条")], "s string")
    return df.select("s", numerals("s").alias("n"))


@register("text_functions", values("k, v", ("ascii", '"Hello-World"'), ("unescape", "&"), ("once", "&amp;"), ("balanced", "true"), ("unbalanced", "false"), ("number", "682号"), ("first", "2")))
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    one = spark.range(1)
    put = lambda k, c: one.select(F.lit(k).alias("k"), c.cast("string").alias("v"))
    amp = F.lit("&amp;amp;")
    return (
        put("ascii", text.to_ascii(F.lit("“Hello—World”")))
        .union(put("unescape", text.unescape_html(amp)))
        .union(put("once", text.unescape_html(amp, 1)))
        .union(put("balanced", text.balanced(F.lit("(a(b)c)"), "(", ")")))
        .union(put("unbalanced", text.balanced(F.lit("(a(b)c"), "(", ")")))
        .union(put("number", text.last_number(F.lit("第682号"))))
        .union(put("first", text.first_non_whitespace(F.lit("　 a"), F.lit(0), F.lit(3))))
    )


BOOKS = '<book><title id="1">A</title><title id="2">B</title><title id="3">C</title><author>D</author></book>'


@register("xml_values", values("position, title, all_titles, author", (1, "A", "A B C", "D"), (2, "B", "A B C", "D"), (3, "C", "A B C", "D")))
def xml_values(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(BOOKS,)], "doc string")
    df = df.select("doc", xml.joined(F.col("doc"), "book/title/text()").alias("all_titles"), xml.value(F.col("doc"), "book/author").alias("author"))
    return xml.each(df, "doc", "book/title/text()", "title")


@register("topo_level", "WITH RECURSIVE e AS (SELECT * FROM (VALUES ('a','c'), ('b','c'), ('c','d')) t(src, dst)), l(vertex, level) AS (SELECT v, 0 FROM (VALUES ('a'), ('b')) t(v) UNION ALL SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.vertex) SELECT vertex, MAX(level) AS level FROM l GROUP BY vertex")
def topo_level(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "src string, dst string")
    return graph.levels(spark.createDataFrame([(v,) for v in "abcd"], "vertex string"), edges)


@register("in_degrees", values("vertex, degree", ("a", 0), ("b", 0), ("c", 2), ("d", 1)))
def in_degrees(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("a", "c")], "src string, dst string")
    return graph.in_degrees(spark.createDataFrame([(v,) for v in "abcd"], "vertex string"), edges)


_BUCKET = """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c(user_id, event_id, i, tokens, updated, admitted) AS (SELECT user_id, event_id, i, CAST(2 AS BIGINT) - 1, t, true FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i,
CASE WHEN least(3 - 1, c.tokens + ((e.t - c.updated) // 3600) * 1) > 0 THEN least(3 - 1, c.tokens + ((e.t - c.updated) // 3600) * 1) - 1 ELSE 0 END,
CASE WHEN (e.t - c.updated) // 3600 > 0 THEN c.updated + ((e.t - c.updated) // 3600) * 3600 ELSE c.updated END,
least(3 - 1, c.tokens + ((e.t - c.updated) // 3600) * 1) > 0 FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)
SELECT user_id, event_id, admitted FROM c"""


@register("token_bucket", _BUCKET)
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _buckets(table(spark, d, "events"))


def _buckets(events: DataFrame) -> DataFrame:
    e = events.select("user_id", "event_id", F.date_trunc("second", "ts").cast("timestamp").alias("ts"))
    return limits.limit(e, "user_id", "ts", "event_id", capacity=2, rate=1, interval=3600.0).select("user_id", "event_id", "admitted")


@register("mock_rows", "SELECT COUNT(*) AS n, true AS fits FROM range(1000)")
def mock_rows(spark: SparkSession, d: str) -> DataFrame:
    df = mock.rows(spark, {"name": "str(3,8)", "age": "num(18,65)", "active": "bool()", "gender": "enum(m,f)", "address": {"city": "str(2,5)", "zip": "num(10000,99999)"}, "kind": "user"}, 1000)
    fits = F.length("name").between(3, 8) & F.col("age").between(18, 65) & F.col("gender").isin("m", "f") & F.length("address.city").between(2, 5) & F.col("address.zip").between(10000, 99999) & (F.col("kind") == "user")
    return df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(fits).alias("fits"))


@register("async_map", "SELECT event_id, event_id * 2 AS doubled FROM events WHERE event_type = 'error'")
def async_map(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    e = table(spark, d, "events").where("event_type = 'error'").select("event_id")
    return enrichment.drop_failures(enrichment.enrich(e, lambda r: r["event_id"] * 2, T.LongType())).select("event_id", F.col("result").alias("doubled"))
