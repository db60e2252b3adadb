"""Dictionaries of phrases against plain string methods: many phrases, long texts, overlaps, replacement, reruns."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weft.operators import dictionary, joins


def words(rng, n, low=1, high=4):
    return " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(low, high))) for _ in range(n))


def plainly(text, mapping):
    """Longest first, leftmost, never inside what has been replaced."""
    parts = [(text, False)]
    for old in sorted(mapping, key=lambda p: (-len(p), p)):
        out = []
        for part, done in parts:
            if done:
                out.append((part, done))
                continue
            pieces = part.split(old)
            for i, piece in enumerate(pieces):
                out += ([(mapping[old], True)] if i else []) + [(piece, False)]
        parts = out
    return "".join(p for p, _ in parts)


def test_replaced_is_longest_first(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(0, 40)) for _ in range(60)] + ["", "aabaab", "naïve 😀 ab 😀ab", None]
    mapping = {words(rng, rng.randrange(1, 3)): f"<{i}>" for i in range(25)} | {"ab": "ba", "😀ab": "!", "c": ""}
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    pairs = spark.createDataFrame([*mapping.items(), ("", "x"), (None, "y"), ("ab", "zz")], "original string, alias string")
    found = {r.id: r for r in dictionary.replaced(rows, ["text"], pairs).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else plainly(t, mapping)
        assert found[i].text == want and found[i].text_raw == t and found[i].touched == (want != t), t


def test_replaced_again_begins_from_the_originals(spark):
    rows = spark.createDataFrame([(1, "Ann met Bob"), (2, "nobody")], "id int, text string")
    one = dictionary.replaced(rows, ["text"], spark.createDataFrame([("Ann", "A")], "original string, alias string"))
    two = dictionary.replaced(one.drop("touched"), ["text"], spark.createDataFrame([("Ann", "A"), ("Bob", "B")], "original string, alias string"))
    assert [(r.text, r.text_raw, r.touched) for r in two.orderBy("id").collect()] == [("A met B", "Ann met Bob", True), ("nobody", "nobody", False)]


def test_empty_dictionaries_and_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "original string, alias string")
    assert [r.text for r in dictionary.replaced(rows, ["text"], none).orderBy("id").collect()] == ["a", None]
    assert [r.names for r in dictionary.names_in(rows, "text", none, "original").orderBy("id").collect()] == [[], []]
    for way in (dictionary.contained, dictionary.anchored):
        assert way(rows, none, "text", "original").count() == 0
        assert way(rows.limit(0), spark.createDataFrame([("a",)], "phrase string")).count() == 0


def test_many_phrases_and_a_long_text_take_linear_time(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(6)) for _ in range(50_000))
    rows = spark.createDataFrame([(1, text), (2, "short")], "id int, text string").cache()
    phrase = F.substring(F.sha2(F.col("id").cast("string"), 256), F.lit(1), (F.col("id") % 4 + 3).cast("int"))
    known = spark.range(100_000).select("id", phrase.alias("phrase")).cache()
    parts = {text[i : i + n] for n in range(3, 7) for i in range(len(text))}
    want = {r.id for r in known.collect() if r.phrase in parts}
    rows.count()
    began = time.time()
    found = dictionary.contained(rows, known.withColumnRenamed("id", "pid")).select("id", "pid").collect()
    assert {r.pid for r in found if r.id == 1} == want and 10_000 < len(want) < 90_000
    assert time.time() - began < 60
    few = known.where("id % 50 = 0")
    began = time.time()
    assert {r.pid for r in dictionary.anchored(rows, few.withColumnRenamed("id", "pid")).select("id", "pid").collect() if r.id == 1} == {i for i in want if i % 50 == 0}
    assert time.time() - began < 60


def test_beyond_the_bound_phrases_are_joined(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_CHARS", 3)
    rows = spark.createDataFrame([(1, "one two three four five"), (2, "x")], "id int, text string")
    known = spark.createDataFrame([("two three four five",), ("x",), ("zz",)], "phrase string")
    assert sorted((r.id, r.phrase) for r in dictionary.contained(rows, known).collect()) == [(1, "two three four five"), (2, "x")]
    with pytest.raises(ValueError):
        dictionary.names_in(rows, "text", known, "phrase")


def test_unmistakable(spark):
    names = spark.createDataFrame([("Ann",), ("Anna",), ("Bob",), ("Bob",), (None,)], "name string")
    assert [r.name for r in joins.unmistakable(names).collect()] == ["Bob"]


def test_counted_and_findings(spark, monkeypatch):
    rng = random.Random(6)
    texts = [words(rng, rng.randrange(0, 30)).replace("b a", "b\na") for _ in range(50)] + ["aaaa aaa", "", None, "x😀 aa\n😀aa"]
    phrases = ["aa", "a", "b c", "cab", "😀", "zz", "abc a"]
    rows, known = spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(p, k) for p in phrases for k in "xy"] + [("", "x"), (None, "x")], "phrase string, kind string")
    want = {(i, p, t.count(p), t.index(p)) for i, t in enumerate(texts) if t for p in phrases if p in t}
    found = dictionary.findings(rows, "id", "text", known, "phrase", around=3).collect()
    assert {(r.id, r.phrase, r.n, r["first"]) for r in found} == want and len(found) == 2 * len(want)
    for r in found:
        t = texts[r.id]
        assert r.line_no == t[: r["first"]].count("\n") + 1
        assert r.context == t[max(0, r["first"] - 3) : r["first"] + len(r.phrase) + 3].replace("\n", " ")
    monkeypatch.setattr(dictionary, "MOST_CHARS", 1)
    assert {(r.id, r.phrase, r.n, r["first"]) for r in dictionary.counted(rows, "text", known, "phrase").collect()} == want
