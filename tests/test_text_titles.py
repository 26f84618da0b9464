import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from quillspark.functions import collections as coll
from quillspark.functions import config, dates, numbers, text
from quillspark.operators import extract, titles
from quillspark.plans import fixtures


@pytest.mark.parametrize("case", [*fixtures.PAIRED, *fixtures.KEYED], ids=lambda c: c[0])
def test_spans(case):
    assert [tuple(s) for s in case[2](case[1])] == case[3]


def test_spans_of_nothing():
    assert extract.paired("|", "|")("|a|b|") == []
    assert extract.paired("《", "》", strategy="outermost")("《A《B》C") == []
    for empty in (lambda: extract.keywords([]), lambda: extract.Chain()("a"), lambda: extract.paired("(", ")", strategy="odd")):
        with pytest.raises(ValueError):
            empty()


def test_chain_by_extractor():
    c = extract.Chain([extract.paired("[", "]")]).then(extract.pattern(r"\d+"), extract.pattern("[A-Z]+"))
    assert c.by_extractor("参考[123ABC]和[456DEF]的规定") == [[("123", 3, 6), ("456", 12, 15)], [("ABC", 6, 9), ("DEF", 15, 18)]]


@pytest.mark.parametrize("title, core", fixtures.TITLES)
def test_core_terms(title, core):
    assert titles.CoreTerm(fixtures.NAMES)(title) == core


def test_blank_title():
    with pytest.raises(ValueError, match="Input text cannot be empty"):
        titles.CoreTerm(fixtures.NAMES)("  ")


def test_about_is_a_prefix_outside_strict_mode():
    loose, strict = titles.TitleTokenizer(fixtures.NAMES, nested=True), titles.TitleTokenizer(fixtures.NAMES, strict=True, nested=True)
    assert [p.text for p in loose("甲省关于水").prefixes] == ["甲省关于"] and loose("甲省关于水").core.text == "水"
    assert strict("甲省关于水").prefixes == [] and strict("关于水").core.text == "水"
    assert titles.whole_title("民法典（2020 年）").core == ("民法典（2020 年）", 0, 10)


def test_case_and_article_numbers():
    single = extract.case_numbers("（2025）沪0101刑初第682号")
    assert [e.alias for e in single] == [None]
    assert [(e.text, e.start, e.alias) for e in extract.articles("依第一条、第十二条和第二十、二十一条")] == [("第一条", 1, "1"), ("第十二条", 5, "12"), ("第二十", 10, "20"), ("二十一条", 14, "21")]


def test_dynamic_abbreviations_count_from_their_definition():
    found = [e for e in extract.entities("甲法《某某法》（以下简称“甲法”）适用甲法，甲法律不算", None) if e.type == "LAW_DYNAMIC_ABBR"]
    assert [(e.start, e.def_start) for e in found] == [(13, 13), (19, 13)]


def test_excluded_phrases_use_up_their_text():
    assert [e.text for e in extract.entities("公司法人与公司法") if e.type == "LAW_ABBR"] == ["公司法"]


def test_issue_number_without_group():
    assert [e.text for e in extract.entities("（第12号）") if e.type == "ISSUE_NO"] == ["（第12号）"]


@pytest.mark.parametrize("s, n", [("一", 1), ("十", 10), ("十五", 15), ("九十九", 99), ("一百", 100), ("一百零一", 101), ("一千零三十", 1030), ("二万三千", 23000), ("一二三", 123), ("", None), ("百", None), ("十百", None), ("甲", None)])
def test_numerals(s, n):
    assert numbers.numeral(s) == n


def test_hash_ignores_order():
    assert numbers.stable_hash([1, 2]) == numbers.stable_hash((2, 1)) != numbers.stable_hash([1, 3])


@pytest.mark.parametrize("attempt, status, due", [(1, 500, True), (1, 400, False), (1, 200, False), (1, 429, True), (4, 500, False)])
def test_retry_table(spark, attempt, status, due):
    assert spark.range(1).select(numbers.retryable(F.lit(attempt), F.lit(status))).first()[0] is due


def test_text_columns(spark):
    one = spark.range(1)
    of = lambda c: one.select(c).first()[0]
    assert of(text.remove_whitespace(F.lit("a　 b \x1cc"))) == "abc"
    assert of(text.replace_whitespace(F.lit("a \n b"), "$")) == "a$b"
    assert of(text.fullwidth_to_halfwidth(F.lit("ＡＢ１　"))) == "AB1 "
    assert of(text.balanced(F.lit("|a|"), "|", "|")) and not of(text.balanced(F.lit(")("), "(", ")"))
    assert of(text.split_equivalents(F.lit("a，b、c,"), ",")) == ["a", "b", "c", ""]
    assert of(text.strip_bookmarks(F.lit("《甲》"))) == "甲"
    assert of(text.one_left_bracket(F.lit("T <b>(20"), F.lit(1), F.lit(8))) and not of(text.one_left_bracket(F.lit("T (("), F.lit(1), F.lit(4)))
    assert of(text.first_non_whitespace(F.lit("ab"), F.lit(1), F.lit(1))) == -1
    assert [tuple(s) for s in of(text.match_spans(F.lit("😀12a345"), "[0-9]+"))] == [("12", 1, 3), ("345", 4, 7)]
    assert [tuple(s) for s in of(text.keyword_spans(F.lit("abcd"), ["ab", "bc", "abc", "bcd"]))] == [("abc", 0, 3)]
    assert of(text.render("{{a}}-{{ b }}", a=F.lit(1), b=F.lit("x"))) == "1-x"
    assert of(text.unescape_xml(F.lit("&lt;a&gt; &amp;amp;"))) == "<a> &amp;"
    assert of(text.plain_number(F.lit(1.3812345678e10))) == "13812345678"
    assert tuple(of(F.struct(*text.clamp(F.lit(-3), F.lit(99), F.lit(5))))) == (2, 5)
    assert of(text.is_whitespace(F.lit("　"))) and of(text.is_digit(F.lit("１２")))


def test_dates(spark):
    one = spark.range(1)
    assert one.select(dates.epoch_at_offset(F.lit("2018-07-19"))).first()[0] == 1531929600
    assert tuple(one.select(dates.local_parts(F.lit(1531958400))).first()[0]) == (2018, 7, 19)
    assert dates.parse_duration("90 min") == dt.timedelta(minutes=90) and dates.parse_duration("500") == dt.timedelta(milliseconds=500)
    with pytest.raises(ValueError):
        dates.parse_duration("soon")


def test_config(tmp_path):
    tree = {"a": {"b": [{"c": 1}, None]}, "x.y": "z", "t": "5 min"}
    assert config.flatten(tree["a"]) == {"b[0].c": "1", "b[1]": ""}
    assert config.unflatten({"a.b[1].c": 1, "a.d": 2}) == {"a": {"b": [None, {"c": 1}], "d": 2}}
    assert config.unflatten({"a": 1, "a.b": 2}) == {"a": {"b": 2}}
    c = config.Config(tree).merged({"a": {"e": True}})
    assert c.get("a.b[0].c", int) == 1 and c.get("x.y") == "z" and c.get("a.e", bool) is True and c.get("nope", int, 7) == 7
    assert c.get("a.b[0].c", decimal.Decimal) == decimal.Decimal(1) and c.get("t", dt.timedelta) == dt.timedelta(minutes=5)
    with pytest.raises(KeyError):
        c.required("nope")
    (tmp_path / "config.json").write_text('{"k": 1}')
    assert config.Config.load_default(folders=[tmp_path]).get("k", int) == 1
    with pytest.raises(FileNotFoundError):
        config.Config.load_default("other", folders=[tmp_path])


def test_collections(spark):
    df = spark.createDataFrame([(2, "b", 0), (1, "a", 1), (2, "a", 2)], "k int, v string, i int")
    assert [tuple(r) for r in coll.group_lists(df, "k", "v", "i").orderBy("first").collect()] == [(2, 0, ["b", "a"]), (1, 1, ["a"])]
    kept, removed = coll.partition(F.array(F.lit(1), F.lit(None), F.lit(3)), lambda x: x > 1)
    assert tuple(spark.range(1).select(kept, removed).first()) == ([1, None], [3])
    assert coll.typed_attribute({"M": {"a": {"N": "2"}, "b": {"N": "2.5"}, "c": {"L": [{"S": "x"}]}}}) == {"a": 2, "b": 2.5, "c": ["x"]}
