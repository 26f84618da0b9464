"""Inverted-index search over document titles, all entities at once, as joins on the core term.

Postings are a long table (index_name, key, doc_id): an intersection counts distinct keys, a union is a semi join. Every ranking
ends with ``doc_id``, so equal documents come in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.dates import date_keys
from quillspark.operators import titles
from quillspark.operators.extract import ABBREVIATIONS, PROMULGATORS
from quillspark.session import cut

COUNTRY = "全国"
COMMON_PREFIXES = ("中华人民共和国",)
INEFFECTIVE = ("尚未生效", "征求意见稿或草案", "To be effective", "Draft for comments or Draft")

DOC_META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "doc_type", "doc_url", "title", "core_term")]
    + [T.StructField("status", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("created_at", "updated_at", "release_date")]
    + [T.StructField("version", T.StringType()), T.StructField("version_timestamp", T.LongType()), T.StructField("is_english", T.BooleanType()), T.StructField("promulgators", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("effective_status", "effective_scope")]
    + [T.StructField("effective_date", T.LongType()), T.StructField("max_article_num", T.IntegerType()), T.StructField("min_article_num", T.IntegerType())]
)


def full_name(name: Column) -> Column:
    """A promulgator's full name, or the name itself."""
    table = F.create_map(*[F.lit(x) for kv in PROMULGATORS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def full_title(abbreviation: Column) -> Column:
    """An abbreviation's full title, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.try_element_at(table, abbreviation)


def postings(docs: DataFrame, spans: str = "tokens") -> DataFrame:
    """(index_name, key, doc_id) over eight indexes, of documents with a token-span column; other columns before ``doc_id`` stay as keys of the index."""
    texts = lambda c: F.transform(F.col(spans)[c], lambda s: s["text"])
    none = F.array().cast("array<string>")
    some = lambda c, v: F.when(c, v).otherwise(none)
    given = lambda c: some(F.col(c).isNotNull() & (F.col(c) != ""), F.array(F.col(c)))
    dates = F.concat(date_keys(F.col("release_date")), some(F.coalesce("effective_date", F.lit(0)) != 0, date_keys(F.col("effective_date"))))
    keys = {
        "date": dates,
        "version": some(F.col("version").isNotNull(), F.array("version")),
        "suffix": texts("suffixes"),
        "prefix": F.transform(texts("prefixes"), full_name),
        "promulgator": F.transform(F.coalesce("promulgators", none), full_name),
        "scope": given("effective_scope"),
        "empty_prefix": some(F.size(F.col(spans)["prefixes"]) == 0, F.array(F.col(spans)["core_term"])),
        "inner_empty_prefix": some(F.col(spans)["inner_core"].isNotNull(), F.array(F.col(spans)["inner_core"])),
    }
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("index_name"), k.alias("keys")) for n, k in keys.items()])).alias("_e")
    rest = [c for c in docs.columns if c in ("query_id",)]
    return docs.select(*rest, "doc_id", entries).select(*rest, F.col("_e.index_name"), F.explode("_e.keys").alias("key"), "doc_id").where("key is not null").distinct()


def by_all(index: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """doc_ids with every key; none if there are no keys."""
    found = index.where((F.col("index_name") == name) & F.col("key").isin(keys) if keys else F.lit(False))
    return found.groupBy("doc_id").agg(F.count_distinct("key").alias("_n")).where(F.col("_n") == len(set(keys))).select("doc_id")


def by_any(index: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return index.where((F.col("index_name") == name) & F.col("key").isin(keys) if keys else F.lit(False)).select("doc_id").distinct()


def after(a: Column, b: Column) -> Column:
    """Whether one date is after another; missing and zero dates are after nothing."""
    return F.coalesce((a > b) & (a != 0) & (b != 0), F.lit(False))


def valid_candidate(doc_prefix: str, own_prefix: str) -> Column:
    """Whether a candidate was there for the current document: not released later, and for cases and penalties in effect."""
    d, own = (lambda c: F.col(doc_prefix + c)), (lambda c: F.col(own_prefix + c))
    strict = F.coalesce(own("doc_type").isin("Case", "Administrative Penalty"), F.lit(False))
    idle = after(d("effective_date"), own("release_date")) | F.coalesce(d("effective_status").isin(*INEFFECTIVE), F.lit(False))
    return ~after(d("release_date"), own("release_date")) & ~(strict & idle)


def confidence(n: Column, digits: int | None = None) -> Column:
    c = F.when(n > 0, 1.0 / n).otherwise(0.0)
    return F.bround(c, digits) if digits is not None else c


def ranked(matches: DataFrame, keys: list[str], legislation_first: bool = False) -> DataFrame:
    """The first match of each key with the number of matches. The flags sort as they always did, false first; ``legislation_first`` turns them."""
    from pyspark.sql import Window

    flags = [F.col("doc_type").eqNullSafe("Legislation"), F.col("effective_scope").eqNullSafe(COUNTRY)]
    order = [f.desc() if legislation_first else f.asc() for f in flags]
    w = Window.partitionBy(*keys)
    rows = matches.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order, F.col("release_date").desc(), "doc_id")))
    return rows.where("_r = 1").drop("_r")


def _all_within(left: DataFrame, index: DataFrame, name: str, keys: str) -> DataFrame:
    """(query_id, doc_id) of ``left`` (query_id, ``keys``) whose every key the document has in an index."""
    wanted = left.select("query_id", F.explode(F.array_distinct(keys)).alias("key"))
    sizes = left.select("query_id", F.size(F.array_distinct(keys)).alias("_size"))
    hits = wanted.join(index.where(F.col("index_name") == name), ["query_id", "key"]).groupBy("query_id", "doc_id").agg(F.count_distinct("key").alias("_n"))
    return hits.join(sizes, "query_id").where("_n = _size").select("query_id", "doc_id")


def search(queries: DataFrame, docs: DataFrame, fuzzy_dates: bool = False) -> DataFrame:
    """(query_id, doc_id) matches. ``queries``: query_id, text, type, attrs map<string, array<string>>, and the current document's cur_doc_id, cur_doc_type, cur_release_date.

    LAW_ABBR becomes its full title first; other types than it and LAW_TITLE match nothing. ``fuzzy_dates`` reads dates as digits, since ``2018年`` is no index key.
    """
    promulgators = tuple(PROMULGATORS)
    q = queries.withColumn("text", F.when(F.col("type") == "LAW_ABBR", full_title(F.col("text"))).when(F.col("type") == "LAW_TITLE", F.col("text"))).where("trim(text) <> ''")
    q = q.withColumn("core_term", titles.tokens(F.col("text"), titles.TitleTokenizer(promulgators, nested=True))["core_term"])
    strict_nested = titles.TitleTokenizer(promulgators, strict=True, nested=True)
    q = q.withColumn("span", titles.tokens(F.col("text"), lambda t: (lambda s: s.outer or s)(strict_nested(t)))).withColumn("is_nested", titles.tokens(F.col("text"), strict_nested)["nested"])

    q = cut(q)  # tokens are used many times below, and so are postings

    live = docs.where(F.contains("doc_type", F.lit("Legislation")) & (F.col("status") == 1))
    pairs = q.select("query_id", "core_term", "is_nested", F.col("span")["core_term"].alias("span_core"), F.col("cur_doc_type").alias("cur_doc_type"), "cur_release_date").join(live, "core_term")
    pairs = pairs.withColumnsRenamed({"cur_release_date": "own_release_date", "cur_doc_type": "own_doc_type"}).where(valid_candidate("", "own_"))
    own = lambda t, names, *a, **k: titles.TitleTokenizer({*promulgators, *names}, *a, **k)(t)

    @F.pandas_udf(titles.TOKENS)
    def document_tokens(title, kind, scope, names, nested):
        import pandas as pd

        strict = titles.TitleTokenizer([*promulgators, titles.ABOUT], strict=True, last_only=[titles.ABOUT])
        rows = []
        for t, k, s, n, inside in zip(title, kind, scope, names, nested):
            if k != "Legislation":
                rows.append(titles.as_row(titles.whole_title(t)))
            elif inside or s != COUNTRY:
                rows.append(titles.as_row(strict(t)))
            else:
                rows.append(titles.as_row(own(t, n if n is not None else [], strict=True, nested=True)))
        return pd.DataFrame(rows, columns=titles.TOKENS.names)

    pairs = pairs.withColumn("tokens", document_tokens("title", "doc_type", "effective_scope", "promulgators", "is_nested")).where(F.col("tokens")["core_term"] == F.col("span_core"))
    index = cut(postings(pairs.select("query_id", "doc_id", "tokens", "release_date", "effective_date", "version", "promulgators", "effective_scope")))

    texts = lambda c: F.transform(F.col("span")[c], lambda s: s["text"])
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.array().cast("array<string>"))
    dates = F.transform(attr("DATE"), lambda d: F.regexp_replace(d, "[^0-9]", "")) if fuzzy_dates else attr("DATE")
    q = q.select("query_id", F.transform(texts("prefixes"), full_name).alias("prefixes"), texts("suffixes").alias("suffixes"), F.col("span")["core_term"].alias("core"), dates.alias("dates"), attr("ISSUE_NO").alias("issues"), F.transform(attr("PROMULGATOR"), full_name).alias("names"))

    with_prefix = _all_within(q.where(F.size("prefixes") > 0), index, "prefix", "prefixes")
    bare = q.where(F.size("prefixes") == 0)
    empty = bare.select("query_id", F.col("core").alias("key")).join(index.where("index_name = 'empty_prefix'"), ["query_id", "key"]).select("query_id", "doc_id")
    common = bare.select("query_id").join(index.where((F.col("index_name") == "prefix") & F.col("key").isin(*COMMON_PREFIXES)), "query_id").select("query_id", "doc_id")
    first = cut(empty.union(common).union(_all_within(bare.where(F.size("names") > 0), index, "promulgator", "names")).distinct())
    country = index.where((F.col("index_name") == "scope") & (F.col("key") == COUNTRY)).select("query_id", "doc_id")
    about = index.where((F.col("index_name") == "prefix") & (F.col("key") == titles.ABOUT)).select("query_id", "doc_id")
    second = bare.select("query_id").join(first.select("query_id").distinct(), "query_id", "left_anti").join(country.intersect(about), "query_id")
    found = cut(with_prefix.union(first).union(second).distinct())

    asked = q.where(F.size("suffixes") > 0)
    found = found.join(asked.select("query_id"), "query_id", "left_anti").union(found.join(_all_within(asked, index, "suffix", "suffixes"), ["query_id", "doc_id"], "left_semi"))
    asked = q.where((F.size("dates") > 0) | (F.size("issues") > 0) | (F.size("names") > 0))
    hits = None
    for name, keys in (("date", "dates"), ("version", "issues"), ("promulgator", "names")):
        own_hits = _all_within(q.where(F.size(keys) > 0), index, name, keys)
        hits = own_hits if hits is None else hits.union(own_hits)
    return found.join(asked.select("query_id"), "query_id", "left_anti").union(found.join(hits, ["query_id", "doc_id"], "left_semi")).distinct()


def search_best(queries: DataFrame, docs: DataFrame, legislation_first: bool = False, fuzzy_dates: bool = False) -> DataFrame:
    """(query_id, confidence, doc_id, total): a row for each query, best document other than the current one, or nulls and 0.0."""
    found = search(queries, docs, fuzzy_dates).join(queries.select("query_id", "cur_doc_id"), "query_id").where(~F.col("doc_id").eqNullSafe(F.col("cur_doc_id")))
    best = ranked(found.select("query_id", "doc_id").join(docs, "doc_id"), ["query_id"], legislation_first)
    out = queries.select("query_id").join(best.select("query_id", "doc_id", "total"), "query_id", "left")
    n = F.coalesce("total", F.lit(0))
    return out.select("query_id", confidence(n, 2).alias("confidence"), "doc_id", n.alias("total"))


def similar_titles(queries: DataFrame, docs: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, doc_id, distance): titles of the same core term within an edit distance."""
    pairs = queries.select("query_id", "core_term", "text").join(docs.select("doc_id", "core_term", "title"), "core_term")
    return pairs.withColumn("distance", F.levenshtein("text", "title")).where(F.col("distance") <= most).select("query_id", "doc_id", "distance")
