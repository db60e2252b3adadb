from pyspark.sql import functions as F

from weft.functions import parsing as P
from weft.operators import style


def test_loose_json():
    assert P.loose_object('Sure:\n```json\n{"a": [1, 2,], "b": "x",}\n```') == {"a": [1, 2], "b": "x"}
    assert P.loose_object('text {"a": {"b": 1}} more {"c": 2}') == {"a": {"b": 1}}
    assert P.loose_object("{“a”：“b”，“c”：1}") == {"a": "b", "c": 1}
    assert P.loose_object('{"a": 1, "b": [1, 2') == {"a": 1, "b": [1, 2]}
    assert P.loose_object('{"a": 1, "b": "cut of') == {"a": 1, "b": "cut of"}
    assert P.loose_object('{"a": 1, "b') == {"a": 1}
    assert P.loose_object(None) is P.loose_object("none") is P.loose_object("{") or P.loose_object("{") == {}
    assert P.loose_items('[{"a": 1}, {"a": 2}, {"a": 3, "b') == [{"a": 1}, {"a": 2}]
    assert P.closed('{"a": [1') == '{"a": [1]}' and P.closed('{"a') is None and P.closed("{]") is None


def test_numerals(spark):
    cases = {"12": 12, "十": 10, "二十三": 23, "一百零五": 105, "两千": 2000, "一万二千": 12_000, "一二三": 123, "": None, "abc": None, None: None}
    assert {k: P.numeral(k) for k in cases} == cases
    got = spark.createDataFrame([(k,) for k in cases], "t string").select(P.number_of("t").alias("n"), P.parsed(F.lit('{"b": 1, "a": 2,}')).alias("j")).collect()
    assert [r.n for r in got] == list(cases.values()) and got[0].j == '{"a": 2, "b": 1}'


def test_style(spark):
    text = "Fine line.\nAB## CD the the end HELLO BIG WORLD"
    assert [x[0] for x in style.issues(text)] == ["symbols", "repeated_word", "shouting"]
    rules = (style.StyleRule("wide", "the the end", "low"), style.StyleRule("narrow", "the", "high"))
    assert [x[0] for x in style.issues("the the end, the", rules)] == ["wide", "narrow"]
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    found = style.scan(rows, "id", "text")
    assert sorted((r.rule, r.line) for r in found.collect()) == [("repeated_word", 2), ("shouting", 2), ("symbols", 2)]
    got = {r.id: (r.issues, round(r.score, 6), r.grade) for r in style.score(found, rows, "id", "text").collect()}
    assert got == {1: (3, round(100 - 2.2 * 12 / 0.5, 6), "D"), 2: (0, 100.0, "A"), 3: (0, 100.0, "A")}
