"""Queries over all events and whole texts, on users and characters far from the first."""

import datetime as dt

import duckdb
import pytest
from test_registry import ORACLES, QUERIES, rows

NAMES = sorted([*(x for x in QUERIES if x.startswith("overlap_")), "attribute_sets", "sentence_free", "session_windows", "token_bucket"])


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Users 40 to 1,540 and texts that end a sentence only after 50 characters."""
    d = str(tmp_path_factory.mktemp("far"))
    at = dt.datetime(2024, 1, 1)
    events = [(i, at + dt.timedelta(seconds=i * i * 37 % 20_000), 40 + i % 4 * 500, ("view", "error", "purchase")[i % 3], float(i * 7 % 90)) for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(1, "no end " * 9 + "here."), (2, "no end " * 9), (3, "A. " + "b" * 80)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_names():
    assert len(NAMES) == 10
    assert not any("user_id <" in x for x in ORACLES.values())


@pytest.mark.parametrize("name", NAMES)
def test_whole(spark, far, name):
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{far}/{t}.parquet/*.parquet')")
    pdf = QUERIES[name](spark, far).toPandas()
    assert rows(pdf) == rows(con.execute(ORACLES[name]).df())
    if name == "sentence_free":
        assert dict(zip(pdf["doc_id"], pdf["free"])) == {1: False, 2: True, 3: False}
    else:
        assert set(pdf["user_id"]) == {40, 540, 1040, 1540}
