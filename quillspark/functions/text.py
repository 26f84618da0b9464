"""Text functions as Columns. Offsets are code points; ``end`` is exclusive."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with an ASCII form beside the full-width block (which follows a rule).
VARIANTS = {
    "{": "﹛❴", "}": "﹜❵", "<": "\u2329\u3008\u300a", ">": "\u232a\u3009\u300b", "[": "【〔〖〘〚﹝", "]": "】〕〗〙〛﹞", "(": "❲﹙⁽₍❨﴾", ")": "❳﹚⁾₎❩﴿",
    '"': "“”„‟«»〝〞〟「」『』", "'": "‘‚‛", ",": "、", "-": "—", " ": "\u3000\xa0\u2007\u202f\ufeff\u202a\x00\u3164\u2800\u180e",
}
SPACE = r"(?U)[\s\x1c-\x1f]"


def ascii_map() -> dict[str, str]:
    """Every character that has an ASCII form: the variants above, and the full-width block."""
    full = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    return full | {v: k for k, vs in VARIANTS.items() for v in vs}


def _translate(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def to_ascii(text: Column) -> Column:
    return _translate(text, ascii_map())


def fullwidth_to_halfwidth(text: Column) -> Column:
    return _translate(text, {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys("\u3000\xa0\u2007\u202f", " "))


def equivalents(symbol: str) -> str:
    """A symbol with all characters that map to it."""
    return symbol + "".join(k for k, v in ascii_map().items() if v == symbol)


def remove_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def replace_whitespace(text: Column, by: str) -> Column:
    return F.regexp_replace(text, SPACE + "+", by.replace("\\", r"\\").replace("$", r"\$"))


def unescape(text: str | None, most: int = 3) -> str | None:
    """HTML entities resolved until nothing changes, ``most`` times at most, once at least."""
    for _ in range(max(1, most)) if text is not None else ():
        after = html.unescape(text)
        if after == text:
            break
        text = after
    return text


def unescape_html(text: Column, most: int = 3) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unescape(t, most) if t and "&" in t else t)

    return of(text)


def unescape_xml(text: Column) -> Column:
    """The five XML entities, without leaving the JVM."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_equivalents(text: Column, symbol: str, more: str = "") -> Column:
    return F.btrim(text, F.lit(equivalents(symbol) + more))


def split_equivalents(text: Column, symbol: str) -> Column:
    return F.split(text, "[" + re.escape(equivalents(symbol)) + "]", -1)


def has_equivalents(text: Column, symbol: str, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start).rlike("[" + re.escape(equivalents(symbol)) + "]")


def strip_bookmarks(text: Column) -> Column:
    return F.btrim(text, F.lit(equivalents("<") + equivalents(">")))


def clamp(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """Slice bounds as Python reads them: negative from the end, then within the text."""
    at = lambda x: F.least(F.greatest(F.when(x < 0, x + size).otherwise(x), F.lit(0)), size)
    return at(start), at(end)


def balanced(text: Column, left: str, right: str) -> Column:
    """Whether a pair is balanced and never closes first; of equal symbols an even number."""
    if left == right:
        return (F.length(text) - F.length(F.replace(text, F.lit(left), F.lit("")))) % (2 * len(left)) == 0
    marks = F.regexp_extract_all(text, F.lit(f"({re.escape(left)}|{re.escape(right)})"), F.lit(0))
    step = lambda a, m: F.struct((a["n"] + F.when(m == left, 1).otherwise(-1)).alias("n"), F.least(a["low"], a["n"] + F.when(m == left, 1).otherwise(-1)).alias("low"))
    end = F.aggregate(marks, F.struct(F.lit(0).alias("n"), F.lit(0).alias("low")), step)
    return (end["n"] == 0) & (end["low"] == 0)


def is_whitespace(text: Column) -> Column:
    return text.rlike(r"(?U)\A[\s\x1c-\x1f" + "".join(f"\\x{{{ord(c):x}}}" for c in VARIANTS[" "]) + r"]\z")


def is_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\A\d+\z")


def last_number(text: Column) -> Column:
    """The digits at the end; the last character counts even if it is none."""
    return F.regexp_extract(text, r"(?Us)(\d*.)\z", 1)


def first_non_whitespace(text: Column, start: Column, end: Column) -> Column:
    """Index of the first other character in a range: -1 in an empty range, ``end`` if all is blank."""
    part = F.substring(text, start + 1, end - start)
    return F.when(end <= start, F.lit(-1)).otherwise(end - F.length(F.regexp_replace(part, r"\A" + SPACE + "+", "")))


def plain_number(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0"))


def render(template: str, **values: Column) -> Column:
    """``{{name}}`` in a template replaced by columns, all in one pass."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])


def free_of_sentence_end(text: Column, start: Column, end: Column) -> Column:
    return ~F.substring(text, start + 1, F.greatest(end - start, F.lit(0))).rlike("[?!.。？！]")


def one_left_bracket(text: Column, start: Column, end: Column) -> Column:
    """Whether a range begins, after blanks and tags, with its only left bracket."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0))).rlike(r"\A(?:(?U:\s)|<[^>]*>)*[(（][^(（]*\z")


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of a pattern's matches, as code points, without Python."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
        F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(x["m"].alias("text"), (a["at"] + F.length(x["gap"])).alias("start"), (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"))))).alias("out"),
    )
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out")), step)["out"]


def keyword_spans(text: Column, keywords: list[str]) -> Column:
    """Leftmost-longest non-overlapping keywords, as one escaped alternation."""
    if not keywords:
        raise ValueError("no keywords")
    return match_spans(text, "|".join(re.escape(k) for k in sorted(set(keywords), key=lambda k: (-len(k), k))))
