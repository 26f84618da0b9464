"""Numerals, hashes, back-off and retry decisions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits and units of Chinese numerals.
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}

RETRY_STATUS = (429, 500, 502, 503, 504)


def numeral(text: str | None) -> int | None:
    """A Chinese or Arabic numeral up to the ten-thousands, or None if it isn't one."""
    if not text:
        return None
    if text.isascii() and text.isdigit():
        return int(text)
    head, myriad, tail = text.rpartition("万")
    if myriad:
        a, b = numeral(head), numeral(tail.lstrip("零")) if tail.lstrip("零") else 0
        return None if a is None or b is None or b >= 10000 or head.isascii() else a * 10000 + b
    if len(text) > 1 and all(c in DIGITS for c in text):
        return int("".join(str(DIGITS[c]) for c in text)) if "零" not in text[:1] else None
    total, digit, limit, gap = 0, None, 10000, False
    for i, c in enumerate(text):
        if c == "零":
            if digit is not None or gap or i == len(text) - 1 and len(text) > 1:
                return None
            gap = True
        elif c in DIGITS:
            if digit is not None:
                return None
            digit, gap = DIGITS[c], False
        elif c in UNITS:
            if UNITS[c] >= limit or (digit is None and not (c == "十" and total == 0)):
                return None
            limit = UNITS[c]
            total += (1 if digit is None else digit) * limit
            digit = None
        else:
            return None
    return total + (digit or 0)


@F.pandas_udf(T.LongType())
def numerals(texts: pd.Series) -> pd.Series:
    return texts.map(numeral).astype("Int64")


def stable_hash(value: object) -> int:
    """The same number for the same value on every run: lists, tuples and sets count without order."""

    def plain(v: object) -> object:
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))}
        if isinstance(v, (list, tuple, set, frozenset)):
            return sorted((plain(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False) if isinstance(x, (dict, list)) else x)
        return v

    return int(hashlib.sha256(json.dumps(plain(value), sort_keys=True, ensure_ascii=False).encode()).hexdigest(), 16)


def set_hash(values: Column) -> Column:
    """SHA-256 of an array's sorted JSON, as a Column."""
    return F.sha2(F.to_json(F.array_sort(values)), 256)


def backoff_ms(attempt: Column, factor: float = 0.5) -> Column:
    return (F.lit(factor) * F.pow(F.lit(2.0), attempt) * 1000).cast("bigint")


def retryable(attempt: Column, status: Column, error: Column | None = None, most: int = 3, retry_errors: tuple[str, ...] = ("IOException",), final_errors: tuple[str, ...] = ("InterruptedIOException", "UnknownHostException", "ConnectException", "SSLException")) -> Column:
    """Whether another attempt is due: final errors beat retryable ones, errors beat the status."""
    by_status = F.coalesce(status.isin(*RETRY_STATUS), F.lit(False))
    if error is not None:
        by_status = F.when(error.isin(*final_errors), False).when(error.isin(*retry_errors), True).when(error.isNotNull(), False).otherwise(by_status)
    return (attempt <= most) & by_status
