"""Lines that recur though they are short, numeric, or in two texts only."""

from quillspark.llm import line_templates

LETTERS = "abcdefgh"


def dropped(spark, lines):
    """Of texts of one own line and one of ``lines`` each: whether that one goes."""
    texts = [f"{' '.join(LETTERS[i] * k for k in range(2, 10))}\n{x}" for i, x in enumerate(lines)]
    df = line_templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["line_dedup"]["text"] for r in df.collect()}
    assert all(got[i] in (t, t.split("\n")[0]) for i, t in enumerate(texts))
    return [got[i] != t for i, t in enumerate(texts)]


def test_short_lines(spark):
    for line in ("All rights reserved.", "Page 3", "版权所有不得转载", "すべての権利を保有します"):
        assert dropped(spark, [line, line, line]) == [False, True, True], line
    # few tokens aren't generalised; one word stays
    assert not any(dropped(spark, ["Page 3", "Page 4", "Page 5"]))
    assert not any(dropped(spark, ["Contents", "Contents", "Contents"]))


def test_numeric_lines(spark):
    log = "2024-01-05 12:00:01 INFO worker 3 started job 17"
    assert dropped(spark, [log, log, log]) == [False, True, True]
    assert dropped(spark, [log, "2024-01-06 12:09:44 INFO worker 5 started job 18", "2024-02-01 01:00:02 INFO worker 12 started job 9"]) == [False, True, True]
    # numbers alone are no template
    assert not any(dropped(spark, ["1 2 3 4 5 6", "7 8 9 10 11 12", "13 14 15 16 17 18"]))


def test_lines_of_two_texts(spark):
    line = " ".join(f"w{chr(97 + k)}" for k in range(26)) * 3
    assert dropped(spark, [line, line]) == [False, True]
    assert dropped(spark, ["Thank you.", " Thank  you."]) == [False, True]
    # a template needs three texts
    assert not any(dropped(spark, [f"Dear {n} we thank you for your kind order of yesterday" for n in ("Ann", "Bob")]))
