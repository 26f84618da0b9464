"""Rule strings become Columns: ``nonnull(a)&b=x|y&regex(c,"p")``, classification and routing of events.

A rule is a list of conditions joined by ``&``; blanks around them and empty ones don't count, repeated ones count once. The first
condition kind that recognises a condition's syntax compiles it. A rule without conditions is true. Null fields match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConditionKind(Protocol):
    """A pluggable kind of condition."""

    name: str

    def supports(self, text: str) -> bool: ...

    def compile(self, text: str) -> tuple[list[str], Column]: ...


@dataclass(frozen=True)
class NonNull:
    name: str = "nonnull"
    syntax: str = r"\s*nonnull\(([^()]+)\)\s*"

    def supports(self, text: str) -> bool:
        return re.fullmatch(self.syntax, text) is not None

    def compile(self, text: str) -> tuple[list[str], Column]:
        if not (m := re.fullmatch(self.syntax, text)):
            raise ValueError(f"Invalid '{self.name}' expression: {text}")
        return [m[1].strip()], F.col(f"`{m[1].strip()}`").isNotNull()


@dataclass(frozen=True)
class Equals:
    """``field=v1|v2``: the value's text is one of the alternatives, which keep their inner blanks."""

    name: str = "equals"

    @staticmethod
    def _sides(text: str) -> list[str]:
        sides = text.split("=")
        while len(sides) > 1 and not sides[-1]:
            sides.pop()
        return sides

    def supports(self, text: str) -> bool:
        return len(self._sides(text)) == 2

    def compile(self, text: str) -> tuple[list[str], Column]:
        if not self.supports(text):
            raise ValueError(f"Invalid '{self.name}' expression: {text}")
        left, right = self._sides(text)
        values = [v for v in right.strip().split("|") if v.strip()]
        name = left.strip()
        return [name], F.coalesce(F.col(f"`{name}`").cast("string").isin(values), F.lit(False)) if values else F.lit(False)


@dataclass(frozen=True)
class Regex:
    """``regex(field,"p")``: the whole value matches."""

    name: str = "regex"
    syntax: str = r'\s*regex\(\s*([^,]+?)\s*,\s*"(.*)"\s*\)\s*'

    def supports(self, text: str) -> bool:
        return re.fullmatch(self.syntax, text, re.S) is not None

    def compile(self, text: str) -> tuple[list[str], Column]:
        if not (m := re.fullmatch(self.syntax, text, re.S)):
            raise ValueError(f"Invalid '{self.name}' expression: {text}")
        return [m[1]], F.coalesce(F.col(f"`{m[1]}`").cast("string").rlike(rf"\A(?:{m[2]})\z"), F.lit(False))


KINDS: tuple[ConditionKind, ...] = (NonNull(), Equals(), Regex())


@dataclass(frozen=True)
class Rule:
    name: str | None
    text: str
    fields: tuple[str, ...]
    conditions: Mapping[str, Column] = field(repr=False)

    @property
    def predicate(self) -> Column:
        return reduce(lambda a, b: a & b, self.conditions.values(), F.lit(True))

    def check(self, columns: Sequence[str]) -> None:
        """Rules name their fields, so a missing one is found before the job runs."""
        if missing := [f for f in self.fields if f not in columns]:
            raise ValueError(f"rule {self.name or self.text!r} needs columns {missing}")


def parse(text: str, name: str | None = None, kinds: Sequence[ConditionKind] = KINDS) -> Rule:
    fields: list[str] = []
    conditions: dict[str, Column] = {}
    for part in filter(None, map(str.strip, text.split("&"))):
        kind = next((k for k in kinds if k.supports(part)), None)
        if kind is None:
            raise ValueError(f"no condition kind supports {part!r}")
        names, conditions[part] = kind.compile(part)
        fields += names
    return Rule(name, text, tuple(fields), conditions)


@dataclass(frozen=True)
class Classifier:
    """An event name with its rules."""

    event: str
    rules: tuple[Rule, ...]

    @classmethod
    def of(cls, event: str, rules: Mapping[str, str]) -> Classifier:
        return cls(event, tuple(parse(text, name) for name, text in rules.items()))

    @property
    def any_match(self) -> Column:
        return reduce(lambda a, b: a | b, (r.predicate for r in self.rules), F.lit(False))

    @property
    def all_match(self) -> Column:
        return reduce(lambda a, b: a & b, (r.predicate for r in self.rules), F.lit(True))

    @property
    def first_match(self) -> Column:
        return F.coalesce(*[F.when(r.predicate, r.name) for r in self.rules], F.lit(None).cast("string"))


def classifiers(config: Mapping) -> list[Classifier]:
    """From a configuration tree ``{event: {rules: {name: text}}}``."""
    return [Classifier.of(event, body["rules"]) for event, body in config.items()]


def route(events: DataFrame, found: Sequence[Classifier], label: str = "label", otherwise: str = "unknown") -> DataFrame:
    """Each event once for every classifier that any rule of matches, or once as ``unknown``. Works on streams too."""
    for c in found:
        for r in c.rules:
            r.check(events.columns)
    labels = F.array_compact(F.array(*[F.when(c.any_match, c.event) for c in found])) if found else F.array().cast("array<string>")
    return events.withColumn(label, F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(otherwise)))))
