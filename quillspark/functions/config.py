"""Configuration trees: load, flatten, unflatten, merge, typed values."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from quillspark.functions.dates import parse_duration

_MISSING = object()


def flatten(tree: Any, path: str = "") -> dict[str, str]:
    """``a.b[0].c`` to text; null becomes the empty string."""
    if isinstance(tree, Mapping):
        return {k: v for name, x in tree.items() for k, v in flatten(x, f"{path}.{name}" if path else str(name)).items()}
    if isinstance(tree, Sequence) and not isinstance(tree, str):
        return {k: v for i, x in enumerate(tree) for k, v in flatten(x, f"{path}[{i}]").items()}
    return {path: "" if tree is None else str(tree).lower() if isinstance(tree, bool) else str(tree)}


def unflatten(flat: Mapping[str, Any]) -> dict:
    """The tree of dotted and indexed keys; arrays are padded with nulls, a scalar in the way gives way."""
    tree: dict = {}
    for key, value in flat.items():
        steps = [int(i) if i else name for name, i in re.findall(r"([^.\[\]]+)(?=[.\[]|$)|\[(\d+)\]", key)]
        at: Any = tree
        for step, following in zip(steps, [*steps[1:], None]):
            if isinstance(step, int):
                at.extend([None] * (step + 1 - len(at)))
            if following is None:
                at[step] = value
            else:
                kind = list if isinstance(following, int) else dict
                held = at[step] if isinstance(step, int) else at.get(step)
                at[step] = held if isinstance(held, kind) else kind()
                at = at[step]
    return tree


def merge(left: Any, right: Any) -> Any:
    """``right`` over ``left``: maps merge, lists append, the rest is replaced."""
    if isinstance(left, Mapping) and isinstance(right, Mapping):
        return {**left, **{k: merge(left[k], v) if k in left else v for k, v in right.items()}}
    if isinstance(left, list) and isinstance(right, list):
        return left + right
    return right


class Config:
    """A read-only tree with typed getters. A key is looked up as it is, then as a path."""

    def __init__(self, tree: Mapping | None = None):
        self.tree = dict(tree or {})

    @classmethod
    def load(cls, path: str | Path) -> Config:
        path = Path(path)
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".json":
            import json

            return cls(json.loads(text))
        if path.suffix == ".toml":
            import tomllib

            return cls(tomllib.loads(text))
        if path.suffix == ".properties":
            pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
            return cls(unflatten({k.strip(): v.strip() for k, v in pairs}))
        import yaml

        return cls(yaml.safe_load(text))

    @classmethod
    def load_default(cls, name: str = "config", folders: Sequence[str | Path] = ("~/config", "./config")) -> Config:
        """The first file of that name in the folders, else FileNotFoundError."""
        for folder in folders:
            for suffix in (".yaml", ".yml", ".json", ".toml", ".properties"):
                if (path := Path(folder).expanduser() / (name + suffix)).exists():
                    return cls.load(path)
        raise FileNotFoundError(f"no {name} in {', '.join(map(str, folders))}")

    def node(self, key: str) -> Any:
        if key in self.tree:
            return self.tree[key]
        at: Any = self.tree
        for name, i in re.findall(r"([^.\[\]]+)|\[(\d+)\]", key):
            if i and isinstance(at, list) and int(i) < len(at):
                at = at[int(i)]
            elif name and isinstance(at, Mapping) and name in at:
                at = at[name]
            else:
                return None
        return at

    def get(self, key: str, kind: type = str, default: Any = None) -> Any:
        """The value as ``kind`` (str, int, float, bool, Decimal, timedelta), ``default`` if it is missing or no such value."""
        value = self.node(key)
        try:
            if value is None:
                return default
            if kind is bool:
                return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower(), default)
            return parse_duration(str(value)) if kind is dt.timedelta else kind(str(value)) if kind is decimal.Decimal else kind(value)
        except (ValueError, TypeError, decimal.InvalidOperation):
            return default

    def required(self, key: str, kind: type = str) -> Any:
        if (value := self.get(key, kind, _MISSING)) is _MISSING:
            raise KeyError(f"missing configuration: {key}")
        return value

    def properties(self) -> dict[str, str]:
        return flatten(self.tree)

    def merged(self, other: Config | Mapping) -> Config:
        return Config(merge(self.tree, other.tree if isinstance(other, Config) else other))
