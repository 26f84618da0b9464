"""Spans of text: paired symbols, keywords, patterns, chains of them, and the entities of legal text.

An extractor is a callable ``text -> list[Span]``; offsets are code points, half-open. ``spans_udf`` lifts one into a Column, ``explode_spans`` into
rows. Extraction sees one document at a time, so it needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.numbers import numeral
from quillspark.functions.text import equivalents


class Span(NamedTuple):
    text: str
    start: int
    end: int


Extractor = Callable[[str], list[Span]]
SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def paired(left: str, right: str, include: bool = False, strategy: str = "all", fallback: bool = False) -> Extractor:
    """Spans between a pair of symbols. all: in the order they close; outermost: those in no other pair; innermost: those as deep as their group gets.

    With ``fallback``, if openings stay unclosed at the end, ``outermost`` also gives the least deep of the pairs inside them. Equal symbols never match.
    """
    if strategy not in ("all", "outermost", "innermost"):
        raise ValueError(f"unknown strategy {strategy!r}")
    symbol = re.compile(f"{re.escape(left)}|{re.escape(right)}")
    trim_left, trim_right = (0, 0) if include else (len(left), len(right))

    def extract(text: str) -> list[Span]:
        opened: list[int] = []
        closed: list[tuple[int, int, int, int]] = []  # depth, deepest so far in its group, begin, end
        deepest = 0
        for m in symbol.finditer(text):
            if m[0] == left:
                opened.append(m.start())
                deepest = max(deepest, len(opened))
            elif opened:
                closed.append((len(opened), deepest, opened.pop(), m.start() + len(right)))
                deepest = deepest if opened else 0
        if strategy == "innermost":
            closed = [c for c in closed if c[0] == c[1]]
        elif strategy == "outermost":
            inner = min((c[0] for c in closed if c[0] > 1), default=0) if fallback and opened else 0
            top = [c for c in closed if c[0] == 1]
            closed = top + [c for c in closed if c[0] == inner]
        return [Span(text[b + trim_left : e - trim_right], b + trim_left, e - trim_right) for _, _, b, e in closed]

    return extract


class Automaton:
    """All keywords of a text in one pass: a trie with failure links."""

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.out = [0], [()]
        for w in dict.fromkeys(words):
            if w:
                at = 0
                for c in w:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(0)
                        self.out.append(())
                    at = self.next[at][c]
                self.out[at] = (len(w),)
        queue = list(self.next[0].values())
        for at in queue:
            for c, to in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                self.out[to] += self.out[self.fail[to]]
                queue.append(to)

    def spans(self, text: str) -> list[Span]:
        at, found = 0, []
        for i, c in enumerate(text, 1):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            found += [Span(text[i - n : i], i - n, i) for n in self.out[at]]
        return found


def keywords(words: Iterable[str], ignore_overlaps: bool = False) -> Extractor:
    """Every occurrence of every keyword, by end, longer first; or the leftmost longest ones that don't overlap."""
    words = [w for w in dict.fromkeys(words) if w]
    if not words:
        raise ValueError("no keywords")
    if ignore_overlaps:
        longest_first = re.compile("|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))))
        return lambda text: [Span(m[0], *m.span()) for m in longest_first.finditer(text)]
    return Automaton(words).spans


def pattern(patterns: str | Sequence[str], group: int = 0, stop_on_first: bool = False) -> Extractor:
    """Matches of patterns in the order of the list; with ``stop_on_first`` only those of the first that matches. A pattern without the group gives its whole match."""
    compiled = [re.compile(p) for p in ([patterns] if isinstance(patterns, str) else patterns)]

    def extract(text: str) -> list[Span]:
        found: list[Span] = []
        for p in compiled:
            g = group if p.groups >= group else 0
            found += [Span(m[g], *m.span(g)) for m in p.finditer(text) if m[g] is not None]
            if found and stop_on_first:
                break
        return found

    return extract


class Chain:
    """Levels of extractors: each level runs inside the spans of the one before; offsets stay those of the text."""

    def __init__(self, *levels: Sequence[Extractor]):
        self.levels = levels

    def then(self, *extractors: Extractor) -> Chain:
        return Chain(*self.levels, extractors)

    def _inside(self, text: str, levels: Sequence[Sequence[Extractor]]) -> list[Span]:
        spans = [Span(text, 0, len(text))]
        for level in levels:
            spans = [Span(x.text, x.start + s.start, x.end + s.start) for s in spans for e in level for x in e(s.text)]
        return spans

    def __call__(self, text: str) -> list[Span]:
        if not self.levels:
            raise ValueError("an empty chain")
        return self._inside(text, self.levels)

    def by_extractor(self, text: str) -> list[list[Span]]:
        """The last level's spans, a list for each of its extractors."""
        if not self.levels:
            raise ValueError("an empty chain")
        outer = self._inside(text, self.levels[:-1])
        return [[Span(x.text, x.start + s.start, x.end + s.start) for s in outer for x in e(s.text)] for e in self.levels[-1]]


def spans_udf(extract: Extractor) -> Callable[[Column], Column]:
    """An extractor over a text column: array<struct<text, start, end>>; null text gives an empty array."""

    @F.pandas_udf(T.ArrayType(SPAN))
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in extract(t)] if t else [])

    return of


def explode_spans(df: DataFrame, extract: Extractor, text_col: str = "text") -> DataFrame:
    """A row for each span: the columns of ``df`` but the text, then ord, span_text, start, end."""
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(*rest, F.posexplode(spans_udf(extract)(F.col(text_col))).alias("ord", "_s"))
    return rows.select(*rest, "ord", F.col("_s.text").alias("span_text"), "_s.start", "_s.end")


#: Patterns, keywords and aliases of Chinese legal text.
DATE = r"\d{4}\s*年\s*(?:\d{1,2}\s*月\s*)?(?:\d{1,2}\s*日)?"
ARTICLE = r"第[\d零一二三四五六七八九十百千万]{1,20}(?:[，、,]第?[\d零一二三四五六七八九十百千万]{1,20}){0,10}条"
CASE = r"[（(]\d{4}[)）][^（()）第号]{1,20}(?:第?\d+号?)(?:[，、,]第?\d+号?){0,10}号"
BRACKETS = r"[（(][^（()）]{1,200}[)）]"
ABBREVIATION = r"[（(][^（()）]*?[简下]称为?[\"“]?([^（()）\"“”]+)[\"”]?[)）]"
ISSUES = [
    r"^[（(]第[^（()）]+号[)）]$",
    r"^[（(]([^（()）]+?[发文函令局会字]第?[^（()）]+?号)[^（()）]*?[)）]$",
    r"^[（(][^（()）]*?(法释[^（()）][0-9]{4}[^（()）]第?[0-9]+号)[^（()）]*?[)）]$",
    r"^[（(][^（()）]*?(建制[^（()）][0-9]{4}[^（()）]第?[0-9]+号)[^（()）]*?[)）]$",
    r"^[（(][^（()）]*?(银发[^（()）][0-9]{4}[^（()）]第?[0-9]+号)[^（()）]*?[)）]$",
    r"^[（(][^（()）]*?(发改经贸[^（()）][0-9]{4}[^（()）]第?[0-9]+号)[^（()）]*?[)）]$",
    r"^[（(][^（()）]*?(财税字?[^（()）][0-9]{4}[^（()）]第?[0-9]+号)[^（()）]*?[)）]$",
    r"^[（(][^（()）]*?(公告[^（()）][0-9]{4}[^（()）]第?[0-9]+号)[^（()）]*?[)）]$",
]
KEYWORDS = {
    "THIS_LAW": ["该法"],
    "LAW_SELF": ["本法", "本条例", "本通知", "本细则", "本修正案", "本解释", "本决定", "本规定", "本公告", "本函", "本批复", "本规则", "本实施细则", "本标准", "本指引", "本办法", "本通告", "本指南", "本审查指南", "本节", "本章"],
    "EXCLUDED": ["公司法人", "公司法定", "罪刑法定", "国家赔偿法溯及", "个人所得税法定", "残疾人保障法人"],
}
ABBREVIATIONS = {
    "公司法": "中华人民共和国公司法", "劳动合同法": "中华人民共和国劳动合同法", "民事诉讼法": "中华人民共和国民事诉讼法", "刑事诉讼法": "中华人民共和国刑事诉讼法",
    "行政诉讼法": "中华人民共和国行政诉讼法", "民法典": "中华人民共和国民法典", "刑法": "中华人民共和国刑法", "行政复议法": "中华人民共和国行政复议法", "商标法": "中华人民共和国商标法",
    "著作权法": "中华人民共和国著作权法", "保险法": "中华人民共和国保险法", "反垄断法": "中华人民共和国反垄断法", "反不正当竞争法": "中华人民共和国反不正当竞争法",
    "破产法": "中华人民共和国企业破产法", "企业破产法": "中华人民共和国企业破产法", "调解仲裁法": "中华人民共和国劳动争议调解仲裁法",
}
PROMULGATORS = {
    "全国人大": "全国人民代表大会", "国务院": "国务院", "上交所": "上海证券交易所", "深交所": "深圳证券交易所", "中注协": "中国注册会计师协会", "央行": "中国人民银行",
    "深圳证券交易所": "深圳证券交易所", "上海证券交易所": "上海证券交易所", "中国注册会计师协会": "中国注册会计师协会", "中国人民银行": "中国人民银行", "全国人民代表大会": "全国人民代表大会",
}
ABBREVIATION_ENDS, NOT_AFTER = ("法",), ("制", "务", "令", "规", "律")

COMMA = "[" + re.escape(equivalents(",")) + "]"


class Entity(NamedTuple):
    """``def_start`` and ``def_end``: the definition that a dynamic abbreviation refers to."""

    text: str
    start: int
    end: int
    type: str
    alias: str | None = None
    def_start: int | None = None
    def_end: int | None = None


ENTITY = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("def_start", T.IntegerType()),
        T.StructField("def_end", T.IntegerType()),
    ]
)
_titles, _links = paired("《", "》", strategy="outermost", fallback=True), paired("<a", "</a>", strategy="outermost", fallback=True)
_cases, _articles, _dates = pattern(CASE), pattern(ARTICLE), pattern(DATE)
_issues, _definitions = Chain([pattern(BRACKETS)], [pattern(ISSUES, group=1, stop_on_first=True)]), Chain([pattern(BRACKETS)], [pattern(ABBREVIATION, group=1)])


def _listed(span: Span) -> Iterable[Span]:
    """Items of a list, each one delimiter apart."""
    at = span.start
    for part in re.split(COMMA, span.text):
        yield Span(part, at, at + len(part))
        at += len(part) + 1


def case_numbers(text: str) -> list[Entity]:
    """One entity for each number of a list; later ones inherit what stands before the first one's digits."""
    found: list[Entity] = []
    for span in _cases(text):
        items = list(_listed(span))
        if len(items) == 1:
            found.append(Entity(*span, "CASE_NO"))
            continue
        digits = re.search(r"(\d*)(.)\Z", items[0].text, re.S)
        head = items[0].text[: digits.start()] if digits else ""
        if head:
            found.append(Entity(*items[0], "CASE_NO", items[0].text.strip().rstrip("号") + "号"))
            found += [Entity(*i, "CASE_NO", f"{head}{i.text.strip().strip('第号')}号") for i in items[1:]]
    return found


def articles(text: str) -> list[Entity]:
    """One entity for each article of a list, its number as alias; items without a number are left out."""
    numbered = ((i, numeral(i.text.strip().strip("第条"))) for s in _articles(text) for i in _listed(s))
    return [Entity(*i, "LAW_ARTICLE", str(n)) for i, n in numbered if n is not None]


_STATIC = {w: kind for kind, words in KEYWORDS.items() for w in words} | dict.fromkeys(ABBREVIATIONS, "LAW_ABBR") | dict.fromkeys(PROMULGATORS, "PROMULGATOR")


_static = keywords(_STATIC, ignore_overlaps=True)


def _keyword_entities(text: str, definitions: list[Span]) -> list[Entity]:
    """Keywords with their types. A document's own abbreviations count from their (last) definition on; EXCLUDED phrases only use up text."""
    own = {d.text: d for d in definitions}
    found = []
    for s in (keywords([*_STATIC, *own], ignore_overlaps=True) if own else _static)(text):
        d = own.get(s.text)
        kind = "LAW_DYNAMIC_ABBR" if d else _STATIC[s.text]
        if kind == "EXCLUDED" or (d and s.start < d.start):
            continue
        if kind in ("LAW_ABBR", "LAW_DYNAMIC_ABBR") and s.text.endswith(ABBREVIATION_ENDS) and text[s.end :].lstrip().startswith(NOT_AFTER):
            continue
        found.append(Entity(*s, kind, None, *(d[1:] if d else (None, None))))
    return found


def entities(text: str, doc_type: str | None = None) -> list[Entity]:
    """All entities of a document, in order of precedence: articles, dates, titles, links, keywords, case numbers (of cases only), issue numbers."""
    typed = lambda spans, kind: [Entity(*s, kind) for s in spans]
    found = articles(text) + typed(_dates(text), "DATE") + typed(_titles(text), "LAW_TITLE") + typed(_links(text), "LINK") + _keyword_entities(text, _definitions(text))
    return found + (case_numbers(text) if doc_type == "Case" else []) + typed(_issues(text), "ISSUE_NO")


def extract_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str = "doc_type") -> DataFrame:
    """(id, ent_id, ent_text, start, end, type, alias, def_start, def_end): a row for each entity, ``ent_id`` in order of precedence."""

    @F.pandas_udf(T.ArrayType(ENTITY))
    def of(texts: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([[e._asdict() for e in entities(t, k)] if t else [] for t, k in zip(texts, types)])

    rows = docs.select(id_col, F.posexplode(of(F.col(text_col), F.col(type_col))).alias("ent_id", "_e"))
    return rows.select(id_col, "ent_id", F.col("_e.text").alias("ent_text"), "_e.start", "_e.end", "_e.type", "_e.alias", "_e.def_start", "_e.def_end")
