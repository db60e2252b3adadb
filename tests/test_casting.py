"""Casts of arcs and traits of parts on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weft.operators import casting, dictionary


def test_casts(spark):
    arcs = spark.createDataFrame([("b", 1, "foe 2 came with friend"), ("b", 2, "foe 21 alone"), ("c", 1, "not one"), ("b", 3, None)], "book string, arc int, text string")
    slots = spark.createDataFrame([("b", "hero", "protagonist", 9), ("b", "foe 2", "part", 3), ("b", "foe 21", "part", 5), ("b", "friend", "part", 1), ("c", "x", "part", 2), ("c", "y", "part", 1), ("c", "z", "part", 3), ("c", "x", "part", 2)], "book string, alias string, kind string, first int")
    found = sorted((r.book, r.arc, r["rank"], r.alias) for r in casting.arc_casts(arcs, slots, 2).collect())
    assert found == [("b", 1, 1, "hero"), ("b", 1, 2, "friend"), ("b", 2, 1, "hero"), ("b", 2, 2, "foe 21"), ("b", 3, 1, "hero"), ("c", 1, 1, "y"), ("c", 1, 2, "x")]


def test_traits(spark):
    rows = [(1, {"a": 12.0, "b": -7.0, "c": 3.4}, {"b": "slot", "c": "peer"}), (2, {}, None), (3, None, None), (4, {"b": 4.0}, {"b": "slot"})]
    found = casting.settled_traits(spark.createDataFrame(rows, "id int, v map<string,double>, b map<string,string>"), "id", ["a", "b", "c", "d"], "v", "b").orderBy("id").collect()
    assert [tuple(r)[1:] for r in found] == [({"a": 10, "b": -1, "c": 3, "d": 0}, 1, 1, 1), (None, 0, 0, 0), (None, 0, 0, 0), ({"a": 0, "b": 4, "c": 0, "d": 0}, 0, 0, 3)]


@pytest.mark.parametrize("most_chars", [dictionary.MOST_CHARS, 10])
def test_casts_are_their_definition(spark, monkeypatch, most_chars):
    monkeypatch.setattr(dictionary, "MOST_CHARS", most_chars)
    rng = random.Random(2)
    words = ["foe", "foe 2", "foe 21", "oe", "friend", "two words", "a (b", "end"]
    slots = {(b, rng.choice(words), rng.choice(["part", "part", "side"]), rng.randrange(4)) for b in "bcd" for _ in range(9)} | {("b", "hero", "protagonist", 5), ("b", "foe", "protagonist", 5)}
    arcs = [(rng.choice("bcde"), i, " ".join(rng.choice([*words, "foe 27", "friend9", "x"]) for _ in range(rng.randrange(4)))) for i in range(60)]
    want = []
    for book, arc, text in arcs:
        own = [s for s in slots if s[0] == book]
        hit = [s for s in own if s[2] == "protagonist" or re.search(re.escape(s[1]) + r"(?![0-9])", text)]
        hit = sorted(hit, key=lambda s: (s[2] != "protagonist", s[3], s[1], s[2]))
        want += [(book, arc, s[1], n) for n, s in enumerate((hit or sorted(own, key=lambda s: (s[3], s[1])))[:3], 1)]
    found = casting.arc_casts(spark.createDataFrame(arcs, "book string, arc int, text string").repartition(3), spark.createDataFrame(sorted(slots), "book string, alias string, kind string, first int"), 3)
    assert sorted((r.book, r.arc, r.alias, r["rank"]) for r in found.collect()) == sorted(want)


def test_no_join_has_the_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(casting.storage, "stored", lambda df, name: df)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    spark.range(30).select(F.lit("b").alias("book"), F.col("id").alias("arc"), F.lit(" ".join(words)).alias("text")).write.parquet(f"{tmp_path}/arcs")
    slots = spark.createDataFrame([("b", w, "part", 1) for w in words], "book string, alias string, kind string, first int")
    found = casting.arc_casts(spark.read.parquet(f"{tmp_path}/arcs"), slots, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 90 and "text#" in plan and not [line for line in plan.splitlines() if "Join" in line and "text#" in line]
