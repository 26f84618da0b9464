"""Titles: normalization, core terms, and token spans (prefixes, core, suffixes, nested titles)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import ascii_map, unescape
from quillspark.operators.extract import PROMULGATORS, Span

#: Fixed values.
FORWARD, ABOUT = "转发", "关于"
NESTED = r"^[^<>]*<([^<>]+)>[^<>]*$"
STRICT_NESTED = (
    "^关于(?:印发|发布|公布|公开征求|就|征求|公开征求对)<[^<>]+>的?(?:通知|命令|公告|意见的通知|意见的公告|意见的函|公开征求意见|公开征求意见的通知|的意见|公开征求意见的公告|行业标准意见|国家标准意见的函)?$",
    "^(?:关于)?(?:印发|发布|公布|公开征求|就|征求|公开征求对)?<[^<>]+>的?(?:通知|命令|公告|意见的通知|意见的公告|意见的函|公开征求意见|公开征求意见的通知|的意见|公开征求意见的公告|行业标准意见|国家标准意见的函)$",
)

_to_ascii = str.maketrans(ascii_map())


def squeezed(text: str) -> str:
    """Entities resolved, ASCII forms, no white space at all."""
    if not text or not text.strip():
        raise ValueError("Input text cannot be empty")
    return "".join(unescape(text).translate(_to_ascii).split())


def normalize(text: str) -> str:
    """Entities resolved, ASCII forms, stripped."""
    return unescape(text).translate(_to_ascii).strip()


@dataclass(frozen=True)
class TokenSpan:
    text: str
    core: Span
    prefixes: list[Span] = field(default_factory=list)
    suffixes: list[Span] = field(default_factory=list)
    nested: bool = False
    outer: TokenSpan | None = None
    inner: TokenSpan | None = None


#: A pair of brackets with what it holds, pairs within it included; in the second form it holds something.
BRACKETS = r"(?P<pair>\((?:[^()]|(?&pair))*+\))"
FILLED = r"(?P<filled>\((?:[^()]|(?P<pair>\((?:[^()]|(?&pair))*+\)))++\))"


class _Head:
    """A pattern for what stands before a title's core: a promulgator with its brackets and commas, read again from where it ends."""

    def __init__(self, names: Iterable[str], last_only: Iterable[str] = (), first_only: Iterable[str] = ()):
        self.last_only, self.first_only = frozenset(last_only), frozenset(first_only)
        either = "|".join(regex.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)) if n) or "(?!)"
        self.name, self.step = regex.compile(either), regex.compile(f"(?P<name>{either}){BRACKETS}*+,*+")

    def read(self, text: str) -> tuple[int, list[Span]]:
        """(where it ends, the names within it)."""
        end = 0
        while (found := self.step.match(text, end)) and not (end and found["name"] in self.first_only):
            end = found.end()
            if found["name"] in self.last_only:
                break
        return end, [Span(m[0], *m.span()) for m in self.name.finditer(text, 0, end)]


_ENDS = {strict: (regex.compile(f"(?:{pair})++$"), regex.compile(pair)) for strict, pair in ((False, BRACKETS), (True, FILLED))}


def _tail(text: str, strict: bool) -> tuple[int, list[Span]]:
    """(where the brackets at the end begin, those brackets)."""
    all_of, each = _ENDS[strict]
    found = all_of.search(text)
    if not found:
        return len(text), []
    return found.start(), [Span(m[0], *m.span()) for m in each.finditer(text, found.start())]


def nested_title(text: str) -> Span | None:
    """The one title in angle brackets, unless the text forwards another."""
    m = re.match(NESTED, text) if FORWARD not in text else None
    return Span(m[1], *m.span(1)) if m else None


class CoreTerm:
    """A title's core: the nested title if there is one, less leading promulgators and trailing brackets; never empty."""

    def __init__(self, promulgators: Iterable[str]):
        self.head = _Head(promulgators)

    def __call__(self, title: str) -> str:
        text = squeezed(normalize(title) if title and title.strip() else title)
        text = (nested_title(text) or Span(text, 0, 0)).text
        text = text[self.head.read(text)[0] :] or text
        return text[: _tail(text, False)[0]] or text


class TitleTokenizer:
    """Token spans of titles. nested: titles in angle brackets are looked into, and ``关于`` counts as a prefix."""

    def __init__(self, promulgators: Iterable[str], strict: bool = False, nested: bool = False, first_only: Iterable[str] = (), last_only: Iterable[str] = ()):
        self.head, self.strict, self.nested = _Head(promulgators, last_only, first_only), strict, nested

    def __call__(self, title: str) -> TokenSpan:
        text = squeezed(title)
        base = self._flat(text)
        inside = nested_title(text) if self.nested else None
        if not inside or (self.strict and not any(re.match(p, base.core.text) for p in STRICT_NESTED)):
            return base
        move = lambda s: Span(s.text, s.start + inside.start, s.end + inside.start)
        inner = self._flat(inside.text)
        inner = replace(inner, core=move(inner.core), prefixes=[*map(move, inner.prefixes)], suffixes=[*map(move, inner.suffixes)])
        by_start = lambda a, b: sorted([*a, *b], key=lambda s: s.start)
        return TokenSpan(text, inner.core, by_start(base.prefixes, inner.prefixes), by_start(base.suffixes, inner.suffixes), True, base, inner)

    def _flat(self, text: str) -> TokenSpan:
        begin, prefixes = self.head.read(text)
        if self.nested and FORWARD not in text and not ("<" in text and ">" in text):
            at = text.find(ABOUT, begin)
            if at >= 0 and (at == begin or not self.strict):
                prefixes = [*prefixes, Span(text[begin : at + len(ABOUT)], begin, at + len(ABOUT))]
                begin = at + len(ABOUT)
        end, suffixes = _tail(text, self.strict)
        begin, end = (begin, end) if begin < end else (0, len(text))
        return TokenSpan(text, Span(text[begin:end], begin, end), prefixes, suffixes)


def whole_title(title: str) -> TokenSpan:
    """No tokens: the title as it is, ending where its squeezed form would."""
    text = squeezed(title)
    return TokenSpan(text, Span(title, 0, len(text)))


_SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
TOKENS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("core_term", T.StringType()),
        T.StructField("core", _SPAN),
        T.StructField("prefixes", T.ArrayType(_SPAN)),
        T.StructField("suffixes", T.ArrayType(_SPAN)),
        T.StructField("nested", T.BooleanType()),
        T.StructField("inner_core", T.StringType()),
    ]
)


def as_row(t: TokenSpan) -> dict:
    return {"text": t.text, "core_term": t.core.text, "core": t.core._asdict(), "prefixes": [p._asdict() for p in t.prefixes], "suffixes": [s._asdict() for s in t.suffixes], "nested": t.nested, "inner_core": t.inner.core.text if t.inner else None}


def core_term(title: Column, promulgators: Iterable[str] = tuple(PROMULGATORS)) -> Column:
    """Core term of each title; null and blank titles give null."""
    core = CoreTerm(promulgators)

    @F.pandas_udf("string")
    def of(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: core(t) if t and t.strip() else None)

    return of(title)


def tokens(title: Column, tokenizer: Callable[[str], TokenSpan]) -> Column:
    """Token spans of each title as a struct (TOKENS); null and blank titles give null."""

    @F.pandas_udf(TOKENS)
    def of(titles: pd.Series) -> pd.DataFrame:
        rows = [as_row(tokenizer(t)) if t and t.strip() else dict.fromkeys(TOKENS.names) for t in titles]
        return pd.DataFrame(rows, columns=TOKENS.names)

    return of(title)


def tokens_json(t: Column) -> Column:
    texts = lambda c: F.transform(t[c], lambda s: s["text"])
    return F.to_json(F.struct(t["text"].alias("text"), t["core_term"].alias("core_term"), texts("prefixes").alias("prefixes"), texts("suffixes").alias("suffixes"), t["nested"].alias("nested")))
