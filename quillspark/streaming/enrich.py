"""Enrichment of records by a slow function (an HTTP call): threads of each Python worker, retries, time limits, failure policy.

The operator is ``mapInPandas``, so it works on batches and streams alike. Order isn't kept. Tasks may run again after a lost executor, so
calls must be safe to repeat. Requests in flight are bounded by ``capacity``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.numbers import RETRY_STATUS


class Retryable(Exception):
    """A response whose status asks for another attempt."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts beyond the first, waits of ``factor * 2 ** attempt`` seconds. Final errors are never retried."""

    attempts: int = 3
    factor: float = 0.5
    statuses: tuple[int, ...] = RETRY_STATUS
    errors: tuple[type[BaseException], ...] = (OSError,)
    final: tuple[type[BaseException], ...] = (InterruptedError, ConnectionRefusedError)
    raise_exhausted: bool = True

    def due(self, attempt: int, error: BaseException | None = None, status: int | None = None) -> bool:
        if attempt > self.attempts:
            return False
        if isinstance(error, Retryable):
            return error.status in self.statuses
        return isinstance(error, self.errors) and not isinstance(error, self.final) if error else status in self.statuses

    def call(self, function: Callable[[], object], pause: Callable[[float], None] = time.sleep) -> object:
        attempt = 1
        while True:
            try:
                return function()
            except Exception as e:
                if not self.due(attempt, e):
                    if isinstance(e, Retryable) and not self.raise_exhausted:
                        return None
                    raise
            pause(self.factor * 2**attempt)
            attempt += 1


NEVER = RetryPolicy(attempts=0)


def enrich(df: DataFrame, function: Callable[[dict], object], output: T.StructType, policy: RetryPolicy = NEVER, threads: int = 8, capacity: int = 64, timeout: float = 60.0, keep_errors: bool = True) -> DataFrame:
    """``df`` with ``result`` (of type ``output``) and ``error``: text of a failure or null. A call beyond ``timeout`` seconds is a failure. A None result drops the record."""
    schema = T.StructType([*df.schema.fields, T.StructField("result", output), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(threads)
        try:
            for pdf in batches:
                rows, flying, out = iter(pdf.to_dict("records")), {}, []
                more = True
                while more or flying:
                    while more and len(flying) < capacity:
                        row = next(rows, None)
                        more = row is not None
                        if more:
                            flying[pool.submit(policy.call, lambda row=row: function(row))] = (row, time.monotonic() + timeout)
                    if not flying:
                        break
                    wait(flying, timeout=0.05, return_when=FIRST_COMPLETED)
                    now = time.monotonic()
                    for f in [f for f, (_, until) in flying.items() if f.done() or now > until]:
                        row, _ = flying.pop(f)
                        if not f.done():
                            f.cancel()
                            out.append({**row, "result": None, "error": "timeout"})
                        elif f.exception():
                            out.append({**row, "result": None, "error": f"{type(f.exception()).__name__}: {f.exception()}"})
                        elif f.result() is not None:
                            out.append({**row, "result": f.result(), "error": None})
                yield pd.DataFrame(out, columns=schema.names)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    rows = df.mapInPandas(run, schema)
    return rows if keep_errors else drop_failures(rows)


def drop_failures(rows: DataFrame, observation=None) -> DataFrame:
    """Records without an error; an Observation may count the others."""
    if observation is not None:
        rows = rows.observe(observation, F.count_if(F.col("error").isNotNull()).alias("numRecordsError"))
    return rows.where("error is null").drop("error")


def fail_on_error(rows: DataFrame) -> DataFrame:
    """The job fails with the first error."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("error"))
    return rows.withColumn("error", checked).where("error is null").drop("error")


def http_call(build: Callable[[dict], dict], handle: Callable[[int, bytes], object], timeout: float = 10.0) -> Callable[[dict], object]:
    """A function for ``enrich``: request from a record (url, method, headers, params, body), result from (status, body). JSON is asked for and sent unless headers say otherwise."""

    def call(row: dict) -> object:
        import json
        import urllib.error
        import urllib.parse
        import urllib.request

        spec = build(row)
        url = spec["url"] + ("?" + urllib.parse.urlencode(spec["params"]) if spec.get("params") else "")
        body = spec.get("body")
        body = body if body is None or isinstance(body, bytes) else body.encode() if isinstance(body, str) else json.dumps(body).encode()
        headers = {"Accept": "application/json", **({"Content-Type": "application/json"} if body is not None else {}), **(spec.get("headers") or {})}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=spec.get("method")), timeout=timeout) as r:
                return handle(r.status, r.read())
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Retryable(e.code) from e
            raise RuntimeError(f"status {e.code}") from e

    return call
