import pytest
from pyspark.sql import functions as F

from quillspark.operators import rules, where

EVENTS = [(1, "loader", "prod", "task_1"), (1, "loader", "prod2", "task_1"), (None, "loader", "prod", "task_1"), (1, "loader", "prod", "task_2"), (1, "loader", "prod", None)]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, "start_time int, feature string, service string, task string")


def matches(df, text):
    return [r[0] for r in df.select(rules.parse(text).predicate).collect()]


def test_whole_rule(events):
    assert matches(events, 'nonnull(start_time)&feature=loader&service=prod&regex(task,"^(?!.*_2$).*")') == [True, False, False, False, False]


def test_alternatives(events):
    assert matches(events, "task=task_1|task_2") == [True, True, True, True, False]
    assert matches(events, "task= task_1|task_2") == [True, True, True, True, False]
    assert matches(events, "task=task_3") == [False] * 5


def test_empty_rule_is_true(events):
    assert matches(events, " & ") == [True] * 5


def test_fields_and_errors(events):
    rule = rules.parse("nonnull(a)&a=1&nonnull(a)")
    assert rule.fields == ("a", "a", "a") and len(rule.conditions) == 2
    with pytest.raises(ValueError):
        rules.parse("what is this")
    with pytest.raises(ValueError, match="Invalid 'nonnull'"):
        rules.NonNull().compile("a=1")
    with pytest.raises(ValueError, match="needs columns"):
        rules.route(events, [rules.Classifier.of("e", {"r": "nonnull(missing)"})])


def test_routing(events):
    found = [rules.Classifier.of("a", {"r": "service=prod"}), rules.Classifier.of("b", {"r": "task=task_1", "s": "task=task_2"})]
    rows = rules.route(events, found).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in rows} == {"a": 4, "b": 4}
    assert {r["label"] for r in rules.route(events, []).select("label").collect()} == {"unknown"}


def test_where(events):
    assert where.build([]) is None
    assert where.build({"or": []}) is None
    count = lambda c: events.where(where.build(c)).count()
    assert count({"column": "start_time", "operator": "is", "value": None}) == 1
    assert count([{"column": "service", "operator": "in", "value": ["prod"]}, {"or": [{"column": "task", "operator": "eq", "value": "task_2"}, {"column": "task", "operator": "is", "value": None}]}]) == 2
    with pytest.raises(ValueError):
        where.build({"column": "a", "operator": "almost", "value": 1})


def test_regex_is_a_full_match(spark):
    df = spark.createDataFrame([("ab",), ("ab\n",), ("xab",)], "a string")
    assert [r[0] for r in df.select(rules.parse('regex(a,"ab")').predicate.alias("m")).collect()] == [True, False, False]
    assert df.where(F.lit(True)).count() == 3
