"""Token buckets by event time, for batches and streams, and a cache whose entries age."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.numbers import stable_hash


def admit(tokens: int, updated: float, now: float, capacity: int, rate: int, interval: float, exact_refill: bool = False) -> tuple[bool, int, float]:
    """(admitted, tokens, updated) after one request. The bucket refills ``rate`` tokens for each whole interval that has passed.

    As it always did, the mark moves by an interval for each token gained, up to now; ``exact_refill`` moves it by the whole intervals.
    """
    whole = int((now - updated) // interval)
    if whole > 0:
        gained = whole * rate
        tokens = min(capacity, tokens + gained)
        updated = updated + whole * interval if exact_refill else min(now, updated + gained * interval)
    return (True, tokens - 1, updated) if tokens > 0 else (False, tokens, updated)


class TokenBucket:
    """A limiter for one process."""

    def __init__(self, capacity: int, rate: int, interval: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.rate, self.interval, self.clock = capacity, rate, interval, clock
        self.tokens, self.updated, self._lock = capacity, clock(), threading.Lock()

    def acquire(self) -> bool:
        with self._lock:
            good, self.tokens, self.updated = admit(self.tokens, self.updated, self.clock(), self.capacity, self.rate, self.interval)
            return good


def limit(df: DataFrame, key: str, ts: str, order: str, capacity: int, rate: int, interval: float) -> DataFrame:
    """``df`` with ``admitted``: each key's requests in time order against its own bucket, which is full at its first request."""
    schema = T.StructType([*df.schema.fields, T.StructField("admitted", T.BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, order], kind="stable")
        tokens, updated, out = capacity, None, []
        for now in pdf[ts].astype("int64") / (1e9 if str(pdf[ts].dtype).endswith("[ns]") else 1e6):
            good, tokens, updated = admit(tokens, now if updated is None else updated, now, capacity, rate, interval)
            out.append(good)
        return pdf.assign(admitted=out)

    return df.groupBy(key).applyInPandas(run, schema)


def limit_stream(df: DataFrame, key: str, ts: str, capacity: int, rate: int, interval: float) -> DataFrame:
    """The same on a stream: (key, ts, admitted); a bucket is the state of its key."""
    fields = {f.name: f for f in df.schema.fields}
    output = T.StructType([fields[key], fields[ts], T.StructField("admitted", T.BooleanType())])
    state = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("updated", T.DoubleType())])

    def run(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values(ts, kind="stable")
        tokens, updated = held.get if held.exists else (capacity, None)
        out = []
        for t in pdf[ts]:
            now = pd.Timestamp(t).timestamp()
            good, tokens, updated = admit(tokens, now if updated is None else updated, now, capacity, rate, interval)
            out.append(good)
        held.update((int(tokens), float(updated)))
        yield pdf[[key, ts]].assign(admitted=out)

    return df.select(key, ts).groupBy(key).applyInPandasWithState(run, output, state, "append", "NoTimeout")


def ttl_cache(ttl: float, jitter: float = 1.0, clock: Callable[[], float] = time.monotonic) -> Callable:
    """Results are kept ``ttl`` seconds and up to ``jitter`` more; ``ttl`` of 0 or less keeps none. Positions of arguments count. Calls that miss at the same time all run; the last result stays."""

    def decorate(function: Callable) -> Callable:
        held: dict[int, tuple[float, object]] = {}
        lock = threading.RLock()

        @wraps(function)
        def cached(*args, **kwargs):
            if ttl <= 0:
                return function(*args, **kwargs)
            key = stable_hash({"args": {str(i): repr(a) for i, a in enumerate(args)}, "kwargs": {k: repr(v) for k, v in kwargs.items()}})
            with lock:
                until, result = held.get(key, (float("-inf"), None))
            if clock() < until:
                return result
            result = function(*args, **kwargs)  # not under the lock: it may be slow, or call itself
            with lock:
                held[key] = (clock() + ttl + random.uniform(0, jitter), result)
            return result

        cached.cache_clear = held.clear
        return cached

    return decorate


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """Each key once within its time to live."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)
