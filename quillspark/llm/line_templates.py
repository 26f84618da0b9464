"""Line dedup by a log-template tree (operator 1), DataFrame functions only.

A line's tokens (between ASCII white space) with a digit become ``<*>``. The tree has a fixed depth: token count, then the ``lead`` first tokens (all of
a shorter line). Within a leaf, a token at a place is constant if ``min_docs`` different texts have it there, however many of their lines do; other
tokens are variable fields and become ``<*>``. The template so made recurs if ``min_docs`` different texts have it and at least
``constant`` of the line's tokens without a digit, and ``lead`` of them, are constant. Lines of recurring templates are dropped, but for those of
the template's first text (smallest id), so that nothing is lost altogether. Equal texts are one text and share one decision: copies are left to near-dedup.

Lines of fewer than ``min_tokens`` tokens have no variable fields: they recur only token for token, digits as they are, in ``min_copies`` different
texts. Longer lines that do so recur too, whatever their template. In scripts without spaces a character counts as a token for ``min_units``; only lines
of a single word (fewer than ``min_units``) stay.

Null text stays null, empty text empty; a text that loses all its lines is empty. Null ids come last as first texts; texts of equal ids are told apart by
their hashes. Repeated rows each come back. An empty table gives an empty table. Very long texts are read whole: a text is held by one task, and its lines are rows of
fixed size from then on. Lines are split at ``\\n`` and joined by it. Any other columns pass through under any name; one named like ``out_col`` is replaced.

Plan. One pass over the texts leaves a row of hashes for each line (kept in the checkpoint folder). Lines whose leaf no other text shares leave by a join on the leaf.
Texts are shuffled once, by hash, to meet the lines that remain. Tokens travel as hashes: support is a partial count for each (leaf, place, token), and
each different line asks for its constant tokens once, through one representative. A template's identity is the exclusive or of its
constants' hashes (128 bits); 96 bits of hash stand for a line or a whole text. Every count is pre-aggregated before its shuffle, and a
hot line or leaf meets the other side only in plain joins, which adaptive execution splits. The pass over the lines runs when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, let, packed, unpacked

#: Characters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def keys_of(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def normal(line: Column) -> Column:
    """A line's tokens with single spaces between them; most lines are so already."""
    blank = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\x0c\r":
        blank = blank | line.contains(c)
    return F.when(blank, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """A normal line with its tokens that have a digit generalised."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def line_rows(df: DataFrame, id_col: str, text_col: str, lead: int, min_tokens: int, min_units: int) -> DataFrame:
    """(k1, k2, i, leaf, v1, v2: the line token for token, m1, m2: the masked line, deep: whether it has a template, first: least id) for each line of each different text."""
    # the keys come before the lines, else each line would hash its whole text; no filter stands on a computed line, else Spark would compute it again for the filter
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *keys_of(F.col(text_col)), F.split(text_col, "\n", -1).alias("lines"))
    rows = rows.select("id", "k1", "k2", F.posexplode("lines").alias("i", "line")).where("trim(line) <> ''")
    rows = rows.select("id", "k1", "k2", "i", normal(F.col("line")).alias("line"))
    rows = rows.select("id", "k1", "k2", "i", "line", masked(F.col("line")).alias("mask"))
    count = F.when(F.col("mask") != "", F.length("mask") - F.length(F.replace("mask", F.lit(" "), F.lit(""))) + 1).otherwise(0)
    rows = rows.select("id", "k1", "k2", "i", "line", "mask", count.alias("count"))
    unspaced = F.when(F.col("count") > 0, F.col("count") + F.greatest(F.regexp_count("line", F.lit(UNSPACED)) - 1, F.lit(0)) >= min_units)
    leaf = F.when((F.col("count") >= min_units) | unspaced, F.xxhash64("count", F.substring_index("mask", " ", lead)))  # null: too short to recur
    line, mask = (F.xxhash64("line"), F.hash("line")), (F.xxhash64("mask"), F.hash("mask"))
    rows = rows.select("id", "k1", "k2", "i", leaf.alias("leaf"), line[0].alias("v1"), line[1].alias("v2"), mask[0].alias("m1"), mask[1].alias("m2"), (F.col("count") >= min_tokens).alias("deep"))
    return rows.groupBy("k1", "k2", "i", "leaf", "v1", "v2", "m1", "m2", "deep").agg(F.min("id").alias("first"))


def rank() -> Column:
    """Order of texts: null ids come last."""
    return F.struct(F.col("first").isNull().alias("none"), "first", "k1", "k2")


def later_lines(lines: DataFrame, key: list[str], at_least: int) -> DataFrame:
    """(k1, k2, i) of lines (``key``, k1, k2, i, first) whose key is in ``at_least`` different texts, but for those of the first text."""
    holders = lines.groupBy(*key, "k1", "k2").agg(F.min("first").alias("first"))  # a text has one
    recurring = holders.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(rank()).alias("o")).where(F.col("n") >= at_least)
    recurring = recurring.select(*key, F.col("o.k1").alias("o1"), F.col("o.k2").alias("o2"))
    return lines.join(recurring, key).where("k1 <> o1 or k2 <> o2").select("k1", "k2", "i")


def token_rows(texts: DataFrame, lines: DataFrame, carried: list[str]) -> DataFrame:
    """(k1, k2, ``carried`` columns of ``lines``, plain: tokens of the line without a digit, token: hash of leaf, place and token) for each such token of the lines (k1, k2, i, leaf)."""
    asked = lines.groupBy("k1", "k2").agg(F.collect_list(F.struct("i", "leaf", *[c for c in carried if c != "leaf"])).alias("asked"))
    found = let(F.split("text", "\n", -1), lambda rows: F.transform("asked", lambda a: F.struct(a.alias("a"), F.get(rows, a["i"]).alias("line"))))
    rows = texts.join(asked, ["k1", "k2"]).select("k1", "k2", F.explode(found).alias("r"))
    rows = rows.select("k1", "k2", "r.a.leaf", *[f"r.a.{c}" for c in carried if c != "leaf"], F.split(masked(normal(F.col("r.line"))), " ").alias("tokens"))
    rows = rows.withColumn("plain", F.size(F.array_remove("tokens", "<*>"))).select("k1", "k2", "leaf", *[c for c in carried if c != "leaf"], "plain", F.posexplode("tokens").alias("at", "token"))
    return rows.where("token <> '<*>'").select("k1", "k2", *carried, "plain", F.xxhash64("leaf", "at", "token").alias("token"))


def templates(texts: DataFrame, lines: DataFrame, lead: int, min_docs: int, constant: float) -> DataFrame:
    """(m1, m2, leaf, t1, t2): the template of each masked line with enough constant tokens."""
    # the tokens come out dealt by text, so the different ones of a text are found without a shuffle
    tokens = token_rows(texts, lines, ["leaf"]).select("k1", "k2", "leaf", "token").distinct()
    support = tokens.groupBy("leaf", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf", "token")
    one = lines.groupBy("m1", "m2", "leaf").agg(F.min(F.struct("k1", "k2", "i")).alias("r")).select("r.k1", "r.k2", "r.i", "leaf", "m1", "m2")
    known = token_rows(texts, one, ["leaf", "m1", "m2"]).join(support, ["leaf", "token"])
    found = known.groupBy("m1", "m2", "leaf", "plain").agg(F.count(F.lit(1)).alias("fixed"), F.bit_xor(F.xxhash64("token", F.lit(1))).alias("t1"), F.bit_xor(F.xxhash64("token", F.lit(2))).alias("t2"))
    return found.where((F.col("fixed") >= lead) & (F.col("fixed") >= constant * F.col("plain"))).select("m1", "m2", "leaf", "t1", "t2")


def dropped_lines(texts: DataFrame, lines: DataFrame, lead: int, min_docs: int, constant: float, min_copies: int) -> DataFrame:
    """(k1, k2, places: indexes of dropped lines) of texts (k1, k2, text); ``lines`` as of ``line_rows``, computed already."""
    leaves = lines.where("leaf is not null").select("k1", "k2", "leaf").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(min_docs, min_copies))
    shared = cut(lines.join(leaves, "leaf"))
    deep = shared.where(F.col("deep") & (F.col("n") >= min_docs))
    used = deep.join(templates(texts, deep, lead, min_docs, constant), ["m1", "m2", "leaf"]).select("leaf", "t1", "t2", "k1", "k2", "first", "i")
    lost = later_lines(used, ["leaf", "t1", "t2"], min_docs).union(later_lines(shared, ["v1", "v2"], min_copies))
    return lost.groupBy("k1", "k2").agg(F.collect_set("i").alias("places"))


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lead: int = 3, min_docs: int = 3, constant: float = 0.7, min_tokens: int = 6, min_copies: int = 2, min_units: int = 2, out_col: str = "line_dedup") -> DataFrame:
    """``df`` with ``out_col``: struct<n_lines: long, n_dropped: long, text: string>, the text without its recurring lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = cut(line_rows(df, id_col, text_col, lead, min_tokens, min_units))
    texts = df.select(*keys_of(text), text.alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"))  # every use below has this exchange: Spark shuffles the texts once
    places = dropped_lines(texts, lines, lead, min_docs, constant, min_copies)
    split = F.split("text", "\n", -1)
    rest = F.array_join(let(split, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "places"), lambda i: F.get(x, i))), "\n")
    clean = texts.join(places, ["k1", "k2"], "left").select("k1", "k2", "text", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("places").isNull(), F.col("text")).otherwise(rest).alias("clean"))
    rows = df.select(packed(df, text_col), F.col(text_col).isNull().alias("none"), *keys_of(text))
    joined = rows.join(clean, ["k1", "k2"]).withColumn("text", F.when(~F.col("none"), F.col("text")))
    return unpacked(joined, df, F.struct("n_lines", "n_dropped", F.when(~F.col("none"), F.col("clean")).alias("text")), out_col, {text_col: F.col("text")})
