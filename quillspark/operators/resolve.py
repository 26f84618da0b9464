"""Entity resolution: validate, resolve overlaps, link to the nearest definition, drop orphans. One shuffle by document.

Links are ids, not pointers: ``refers_to`` names an entity of the same document, ``owner`` the title that an attribute belongs to.
"""

from __future__ import annotations

from functools import reduce

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import free_of_sentence_end, one_left_bracket, unescape
from quillspark.operators import spans
from quillspark.operators.asof import asof_join

#: What an entity of a type may refer to, and types that stay without a reference.
DEPENDS_ON = {
    "THIS_LAW": ("LAW_TITLE",),
    "LAW_ARTICLE": ("LAW_TITLE", "LAW_DYNAMIC_ABBR", "LAW_ABBR", "THIS_LAW", "LAW_SELF"),
    "LAW_DYNAMIC_ABBR": ("LAW_TITLE",),
    "LAW_TITLE": ("DATE", "ISSUE_NO", "PROMULGATOR"),
}
ALONE = ("LINK", "CASE_NO", "LAW_ABBR", "LAW_SELF", "LAW_TITLE")


@F.pandas_udf(T.BooleanType())
def _well_formed(texts: pd.Series) -> pd.Series:
    def good(t: str) -> bool:
        try:
            ET.fromstring(f"<root>{unescape(t)}</root>")
        except ET.ParseError:
            return False
        return True

    return texts.map(good)


def outside_tags(text: Column, start: Column) -> Column:
    """Whether the last ``<`` before a place is closed."""
    before = F.reverse(F.substring(text, F.lit(1), start))
    opened, closed = F.instr(before, "<"), F.instr(before, ">")
    return (opened == 0) | ((closed > 0) & (closed < opened))


def outside_links(text: Column, start: Column) -> Column:
    before = F.reverse(F.substring(text, F.lit(1), start))
    opened, closed = F.instr(before, "a<"), F.instr(before, ">a/<")
    return (opened == 0) | ((closed > 0) & (closed < opened))


def _slice(text: Column, start: Column, end: Column) -> Column:
    """A Python slice: a negative start counts from the end."""
    n = F.length(text)
    a = F.greatest(F.when(start < 0, start + n).otherwise(start), F.lit(0))
    return F.substring(text, a + 1, F.greatest(F.least(end, n) - a, F.lit(0)))


def not_a_definition() -> Column:
    """An article of legislation isn't its own definition, which names it within the 200 characters before."""
    marked = F.contains(_slice(F.col("text"), F.col("start") - 200, F.col("start")), F.concat(F.lit("_art_"), F.coalesce("alias", F.lit("None"))))
    return (F.col("type") != "LAW_ARTICLE") | ~F.col("doc_type").eqNullSafe("Legislation") | ~marked


def not_own_title() -> Column:
    """A title or abbreviation isn't part of the document's own title."""
    at = F.instr(F.col("title"), F.col("ent_text")) - 1
    around = _slice(F.col("text"), F.col("start") - at, F.col("start") + F.length("title") - at)
    return ~F.col("type").isin("LAW_ABBR", "LAW_TITLE") | (F.coalesce(at, F.lit(-1)) < 0) | (around != F.col("title"))


def validate(found: DataFrame) -> DataFrame:
    """Entities (with their document's text, doc_type, title) that are well-formed, no definition of themselves and not the document's own title. Cheap checks come first."""
    cheap = found.where(((F.col("type") == "LINK") | outside_tags(F.col("text"), F.col("start"))) & not_a_definition() & not_own_title())
    return cheap.where((F.col("type") == "LINK") | _well_formed("ent_text"))


def _nearest(left: DataFrame, right: DataFrame, at: str, direction: str, right_on: str) -> DataFrame:
    refs = right.select("doc_id", F.col("ent_id").alias("id"), F.col("start").alias("s"), F.col("end").alias("e"))
    return asof_join(left, refs, on=at, by=["doc_id"], direction=direction, right_on=right_on, tie="id")


def link(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` (doc_id, ent_id, doc_type, start, end, type, def_start, ...) with ``refers_to`` and ``owner``. Texts (of ``docs``) are only met by the candidates, to look into the gaps between two entities."""
    self_as_this = (F.col("type") == "LAW_SELF") & ~F.coalesce(F.col("doc_type") == "Legislation", F.lit(False))
    rows = found.withColumn("type", F.when(self_as_this, "THIS_LAW").otherwise(F.col("type")))
    gap = lambda near, what, a, b, bracket: near.select("doc_id", "ent_id", F.lit(what).alias("what"), "r_id", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(bracket).alias("bracket"))
    gaps = []

    # references: the nearest definition that ends before the entity (or before the abbreviation's definition) begins
    for kind in ("THIS_LAW", "LAW_ARTICLE", "LAW_DYNAMIC_ABBR"):
        of_definition = kind == "LAW_DYNAMIC_ABBR"
        own = rows.where(F.col("type") == kind).withColumn("_at", F.col("def_start") if of_definition else F.col("start"))
        gaps.append(gap(_nearest(own, rows.where(F.col("type").isin(*DEPENDS_ON[kind])), "_at", "lower", "e"), "refers", "r_e", "_at", of_definition))

    # attributes: a title right before in brackets (dates and issue numbers), else the next title
    titles = rows.where("type = 'LAW_TITLE'")
    attrs = rows.where(F.col("type").isin(*DEPENDS_ON["LAW_TITLE"]))
    gaps.append(gap(_nearest(attrs.where("type in ('DATE', 'ISSUE_NO')"), titles, "start", "lower", "e"), "back", "r_e", "start", True))
    gaps.append(gap(_nearest(attrs, titles, "end", "ceiling", "s"), "ahead", "end", "r_s", False))

    asked = reduce(DataFrame.unionByName, gaps).where("r_id is not null").join(docs.select("doc_id", "text"), "doc_id")
    free = free_of_sentence_end(F.col("text"), F.col("a"), F.col("b")) & (~F.col("bracket") | one_left_bracket(F.col("text"), F.col("a"), F.col("b")))
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("r_id")))
    picked = asked.where(free).groupBy("doc_id", "ent_id").agg(of("refers").alias("refers_to"), F.coalesce(of("back"), of("ahead")).alias("owner"))
    return rows.join(picked, ["doc_id", "ent_id"], "left")


def drop_orphans(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("refers_to").isNotNull() | F.col("type").isin(*ALONE))


def resolve(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Entities that stay, with their links, and the attributes of titles as a map from type to texts."""
    rows = validate(found.join(docs.select("doc_id", "text", "doc_type", "title"), "doc_id")).drop("text", "title")
    rows = link(spans.resolve(rows, ["doc_id"], "longest", direct_only=True, ord_col="ent_id"), docs)
    owned = rows.where("owner is not null").groupBy("doc_id", "owner", "type").agg(F.array_sort(F.collect_set("ent_text")).alias("v"))
    attrs = owned.groupBy("doc_id", "owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "v")))).alias("attrs")).withColumnRenamed("owner", "ent_id")
    return drop_orphans(rows).join(attrs, ["doc_id", "ent_id"], "left").select("doc_id", "ent_id", "ent_text", "start", "end", "type", "alias", "refers_to", "attrs")


def refer(rows: DataFrame) -> DataFrame:
    """(doc_id, ent_id, target): where following ``refers_to`` ends. Each round doubles the steps, so the rounds follow from the most entities of a document, which are counted when the plan is built."""
    out = rows.select("doc_id", "ent_id", F.coalesce("refers_to", "ent_id").alias("target"))
    longest = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        ends = out.select("doc_id", F.col("ent_id").alias("_e"), F.col("target").alias("_next"))
        out = out.join(ends, (out["doc_id"] == ends["doc_id"]) & (out["target"] == ends["_e"]), "left").select(out["doc_id"], out["ent_id"], F.coalesce("_next", "target").alias("target"))
    return out
