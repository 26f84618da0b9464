"""More registered queries over inline rows, with the expected rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import collections as coll
from quillspark.functions import dates, numbers, text, xml
from quillspark.operators import extract, resolve, search, titles
from quillspark.plans.fixtures import BOOKS, doc_meta, values
from quillspark.plans.registry import register

RETRIES = [(1, 500, None, True), (1, 400, None, False), (1, 200, None, False), (1, 429, None, True), (4, 500, None, False), (1, None, "IOException", True), (1, None, "ConnectException", False), (2, None, "ValueError", False)]


@register("retry_table", values("attempt, status, error, due", *RETRIES))
def retry_table(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([r[:3] for r in RETRIES], "attempt int, status int, error string")
    return df.withColumn("due", numbers.retryable(F.col("attempt"), F.col("status"), F.col("error")))


ARTICLE_TEXT = "依第一条、第十二条和第二十、二十一条"


@register("article_numbers", values("text, start, alias", ("第一条", 1, "1"), ("第十二条", 5, "12"), ("第二十", 10, "20"), ("二十一条", 14, "21")))
def article_numbers(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(1, ARTICLE_TEXT, None)], "doc_id int, text string, doc_type string")
    return extract.extract_entities(df).where("type = 'LAW_ARTICLE'").select(F.col("ent_text").alias("text"), "start", "alias")


ABBREVIATED = "甲法《某某法》（以下简称“甲法”）适用甲法，甲法律不算，公司法人不算，公司法算，本法算（国发〔2018〕12号）2018年5月"


@register("entity_types", values("type, text, start", ("LAW_TITLE", "某某法", 3), ("LAW_DYNAMIC_ABBR", "甲法", 13), ("LAW_DYNAMIC_ABBR", "甲法", 19), ("LAW_ABBR", "公司法", 35), ("LAW_SELF", "本法", 40), ("ISSUE_NO", "国发〔2018〕12号", 44), ("DATE", "2018年5月", 56)))
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(1, ABBREVIATED, "Legislation")], "doc_id int, text string, doc_type string")
    return extract.extract_entities(df).select("type", F.col("ent_text").alias("text"), "start")


@register("posting_dates", values("doc_id, key", *[(i, k) for i, y, m, day in (("law_002", 1996, 7, 12), ("law_006", 2018, 7, 19)) for k in (f"{y}{m:02}{day:02}", f"{y}{m:02}", str(y))]))
def posting_dates(spark: SparkSession, d: str) -> DataFrame:
    docs = doc_meta(spark).where(F.col("doc_id").isin("law_002", "law_006")).withColumn("tokens", titles.tokens(F.col("title"), titles.whole_title))
    return search.postings(docs).where("index_name = 'date'").select("doc_id", "key")


@register("posting_names", values("doc_id, index_name, key", ("law_004", "promulgator", "上海证券交易所"), ("law_004", "promulgator", "其他机构"), ("law_004", "scope", "全国"), ("law_004", "version", "上证发(2016)69号"), ("law_004", "prefix", "上海证券交易所"), ("law_004", "inner_empty_prefix", "章程")))
def posting_names(spark: SparkSession, d: str) -> DataFrame:
    tokenizer = titles.TitleTokenizer(tuple(extract.PROMULGATORS), strict=True, nested=True)
    docs = doc_meta(spark).where("doc_id = 'law_004'").withColumn("tokens", titles.tokens(F.col("title"), tokenizer))
    return search.postings(docs).where("index_name <> 'date'").select("doc_id", "index_name", "key")


CANDIDATES = [(1, 100, 0, "ok", "Case", 50, False), (2, 40, 60, "ok", "Case", 50, False), (3, 40, 60, "ok", "Legislation", 50, True), (4, 40, 0, "尚未生效", "Case", 50, False), (5, None, None, None, "Case", 50, True), (6, 100, 0, "ok", "Case", 0, True)]


@register("valid_candidates", values("id, good", *[(c[0], c[6]) for c in CANDIDATES]))
def valid_candidates(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([c[:6] for c in CANDIDATES], "id int, d_release_date long, d_effective_date long, d_effective_status string, o_doc_type string, o_release_date long")
    return df.select("id", search.valid_candidate("d_", "o_").alias("good"))


CHECKS = [
    (1, "<p>x</p> _art_5 y Article", 18, 25, "Article", "LAW_ARTICLE", "5", "Legislation", "T", True, False, True),
    (2, "<p title='Law", 10, 13, "Law", "LAW_TITLE", None, "Case", "Other", False, True, True),
    (3, "see My Law Title here", 7, 10, "Law", "LAW_TITLE", None, "Case", "My Law Title", True, True, False),
    (4, "<a>Law", 3, 6, "Law", "LAW_TITLE", None, "Case", "Other", True, True, True),
]


@register("validators", values("id, outside, no_definition, not_own", *[(c[0], *c[9:]) for c in CHECKS]))
def validators(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([c[:9] for c in CHECKS], "id int, text string, start int, end int, ent_text string, type string, alias string, doc_type string, title string")
    return df.select("id", resolve.outside_tags(F.col("text"), F.col("start")).alias("outside"), resolve.not_a_definition().alias("no_definition"), resolve.not_own_title().alias("not_own"))


BRACKETED = [(1, "T (2023", True), (2, "T <b> (2023", True), (3, "T ((2023", False), (4, "T 2023", False), (5, "T   ", False)]


@register("single_bracket", values("id, good", *[(i, g) for i, _, g in BRACKETED]))
def single_bracket(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([r[:2] for r in BRACKETED], "id int, s string")
    return df.select("id", text.one_left_bracket(F.col("s"), F.lit(1), F.length("s")).alias("good"))


@register("whole_titles", values('title, core, "end"', ("民法典（2020 年）", "民法典（2020 年）", 10)))
def whole_titles(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([("民法典（2020 年）",)], "title string").withColumn("t", titles.tokens(F.col("title"), titles.whole_title))
    return df.select("title", F.col("t.core_term").alias("core"), F.col("t.core.end").alias("end"))


@register("tokens_json", values("j", ('{"text":"中华人民共和国民法典(2020年)","core_term":"民法典","prefixes":["中华人民共和国"],"suffixes":["(2020年)"],"nested":false}',)))
def tokens_json(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([("中华人民共和国民法典(2020年)",)], "title string").withColumn("t", titles.tokens(F.col("title"), titles.TitleTokenizer(("中华人民共和国",))))
    return df.select(titles.tokens_json(F.col("t")).alias("j"))


@register("typed_numbers", "SELECT s, CASE WHEN x = floor(x) THEN CAST(x AS BIGINT) END AS whole, CASE WHEN x <> floor(x) THEN x END AS part FROM (SELECT s, TRY_CAST(s AS DOUBLE) AS x FROM (VALUES ('2'), ('2.5'), ('-7'), ('x')) t(s)) u")
def typed_numbers(spark: SparkSession, d: str) -> DataFrame:
    whole, part = coll.json_number(F.col("s"))
    return spark.createDataFrame([(s,) for s in ("2", "2.5", "-7", "x")], "s string").select("s", whole.alias("whole"), part.alias("part"))


@register("slices", "SELECT s, a, b, least(greatest(CASE WHEN a < 0 THEN a + length(s) ELSE a END, 0), length(s)) AS lo, least(greatest(CASE WHEN b < 0 THEN b + length(s) ELSE b END, 0), length(s)) AS hi FROM (VALUES ('abcde', -3, 99), ('abcde', 1, -1), ('', 0, 5)) t(s, a, b)")
def slices(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([("abcde", -3, 99), ("abcde", 1, -1), ("", 0, 5)], "s string, a int, b int")
    lo, hi = text.clamp(F.col("a"), F.col("b"), F.length("s"))
    return df.select("s", "a", "b", lo.alias("lo"), hi.alias("hi"))


@register("merged_spans", values("starts", ("0,2,3,9",)))
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<struct<text:string,start:int>>"
    df = spark.createDataFrame([([("a", 0), ("c", 3)], [("b", 2), ("d", 9)])], f"x {kind}, y {kind}")
    return df.select(F.array_join(F.transform(coll.merge_by_start(F.col("x"), F.col("y")), lambda s: s["start"].cast("string")), ",").alias("starts"))


@register("xml_pairs", values("position, l, r", (1, "A", "1"), (2, "B", "2"), (3, "C", "3")))
def xml_pairs(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(BOOKS,)], "doc string")
    pairs = xml.zipped(F.col("doc"), "book/title/text()", "book/title/@id")
    return df.select(F.posexplode(pairs).alias("p", "x")).select((F.col("p") + 1).alias("position"), F.col("x.left").alias("l"), F.col("x.right").alias("r"))


@register("local_dates", values("epoch, y, m, d", (1531958400, 2018, 7, 19), (662659200, 1991, 1, 1), (0, 1970, 1, 1)))
def local_dates(spark: SparkSession, d: str) -> DataFrame:
    p = dates.local_parts(F.col("epoch"))
    return spark.createDataFrame([(1531958400,), (662659200,), (0,)], "epoch long").select("epoch", p["year"].alias("y"), p["month"].alias("m"), p["day"].alias("d"))


@register("row_formats", values("value", ('{"a":1,"b":"x"}',), ("1,x",), ("1|x",), ("x=1",)))
def row_formats(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.sources.files import render_rows

    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = render_rows(df, "json")
    for how in ("csv", "sep(|)", "{{b}}={{a}}"):
        out = out.union(render_rows(df, how))
    return out


#: Code points with an ASCII form, beside U+FF01 to U+FF5E, whose form is 0xFEE0 lower.
ASCII_FORMS = [
    ("{", [0xFE5B, 0x2774]), ("}", [0xFE5C, 0x2775]), ("<", [0x2329, 0x3008, 0x300A]), (">", [0x232A, 0x3009, 0x300B]),
    ("[", [0x3010, 0x3014, 0x3016, 0x3018, 0x301A, 0xFE5D]), ("]", [0x3011, 0x3015, 0x3017, 0x3019, 0x301B, 0xFE5E]),
    ("(", [0x2772, 0xFE59, 0x207D, 0x208D, 0x2768, 0xFD3E]), (")", [0x2773, 0xFE5A, 0x207E, 0x208E, 0x2769, 0xFD3F]),
    ('"', [0x201C, 0x201D, 0x201E, 0x201F, 0xAB, 0xBB, 0x301D, 0x301E, 0x301F, 0x300C, 0x300D, 0x300E, 0x300F]), ("'", [0x2018, 0x201A, 0x201B]),
    (",", [0x3001]), ("-", [0x2014]), (" ", [0x3000, 0xA0, 0x2007, 0x202F, 0xFEFF, 0x202A, 0x3164, 0x2800, 0x180E]),
]
_FORMS = " UNION ALL ".join("SELECT CAST({} AS BIGINT) AS code, '{}' AS ascii".format(c, a.replace("'", "''")) for a, cs in ASCII_FORMS for c in cs)


@register("ascii_table", f"SELECT code, ascii FROM ({_FORMS} UNION ALL SELECT 65281 + i, chr(CAST(33 + i AS INTEGER)) FROM range(94) t(i)) UNION ALL SELECT 65375 + i, chr(CAST(65375 + i AS INTEGER)) FROM range(3) t(i)")
def ascii_table(spark: SparkSession, d: str) -> DataFrame:
    """Every character with an ASCII form (but NUL, which SQL text can't hold), and three that have none."""
    codes = [c for _, cs in ASCII_FORMS for c in cs] + list(range(65281, 65378))
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "code long, ch string")
    return rows.select("code", text.to_ascii(F.col("ch")).alias("ascii"))
