import math

from pyspark.sql import functions as F

from weft.functions import predicates as P
from weft.functions import text as T
from weft.functions import vector as V
from weft.operators import aggregates


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_text_measures(spark):
    one = lambda c, *rows: values(spark, c, [(r,) for r in rows], "t string")
    t = F.col("t")
    assert one(T.without_space(t), " a\tb\nc ") == ["abc"]
    assert one(T.tokens_trunc(t), "abcd", "") == [2, 0]
    assert one(T.tokens_even(t), "abc", "abcd") == [2, 3]
    assert one(T.grams(t, 2), "abca", "a", "") == [["ab", "bc", "ca"], [], []]
    assert one(T.grams(t, 2), "a\n😀b") == [["a\n", "\n😀", "😀b"]]
    assert one(T.repeated_gram_share(t, 2), "abab", "a") == [1 - 2 / 3, 0.0]
    assert one(T.gram_relevance(t, F.lit("abcd")), "xxabyy", "abcd", "") == [1 / 3, 1.0, 0.0]
    assert one(T.gram_relevance(t, F.lit("a")), "abc") == [0.0]
    assert one(T.summary(t), "# head\nshort\nA long paragraph.", "", None) == ["A long paragraph.", "", ""]
    assert one(T.masked_key(t), "secret-1234", "abcd", " ", None) == ["***1234", "***", "", ""]
    assert one(T.without_fences(t), '```json\n{"a": 1}\n```', "plain") == ['{"a": 1}', "plain"]
    assert one(T.name_tags(t), "Red_moon-red moon.a.txt") == [["Red", "moon", "red"]]
    assert one(T.longest_first(t, [("Ann", "A"), ("Anna", "B")]), "Anna, Ann") == ["B, A"]
    assert one(T.snippet(t, ["dog"]), "A cat. The dog ran! Yes.", "none") == ["The dog ran", None]
    assert one(T.without_clauses(t, ["ad"]), "One. An ad here! Two.") == ["One. Two."]
    assert one(T.cut_at_boundary(t, 10), "12345678", "1234567\n90123", "1\n34567890123") == ["12345678", "1234567\n", "1\n34567890"]


def test_jaccard_of_characters(spark):
    got = values(spark, T.jaccard(T.chars(F.col("a")), T.chars(F.col("b"))), [("abc", "bcd"), ("", ""), ("aa", "a")], "a string, b string")
    assert got == [0.5, 0.0, 1.0]


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])]
    got = values(spark, V.cosine(F.col("a"), F.col("b")), rows, "a array<float>, b array<float>")
    assert [round(x, 6) for x in got] == [0.6, 0.0, 0.0]
    assert values(spark, V.normalized(F.col("a")), [([3.0, 4.0],), ([0.0, 0.0],)], "a array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    points = [(math.sin(math.radians(a)), math.cos(math.radians(a))) for a in range(0, 360, 45)]
    assert values(spark, V.bearing(F.col("x"), F.col("y")), [*points, (0.0, 0.0)], "x double, y double") == [*V.POINTS, None]


def test_compare(spark):
    def check(op, a, b):
        return values(spark, P.compare(op, F.col("a"), F.col("b")), [(a, b)], "a string, b string")[0]

    assert check("gt", "10", "9") and not check("gt", "b10", "b9")
    assert check("eq", "1.0", "1") and check("ne", "x", None)
    assert check("contains", "abc", "b") and check("not_contains", None, "b")
    assert check("start_with", "abc", "ab") and check("end_with", "abc", "bc")
    assert check("empty", None, None) and not check("not_empty", "", None)
    assert not check("no such", "a", "a")
    assert values(spark, P.all_or_any([], "or"), [(1,)], "a int") == [True]


def test_snap_and_cache_counts(spark):
    anchors = [0, 1, -1, 4, -4, 7, -7, 10, -10]
    assert values(spark, aggregates.snap(F.col("x"), anchors), [(2.4,), (2.5,), (-5.5,), (0.5,), (99.0,)], "x double") == [1, 1, -4, 0, 10]
    hit, miss = aggregates.cache_counts(F.col("h"), F.col("m"), F.col("p"))
    got = spark.createDataFrame([(3, None, 10), (None, None, 10), (3, 1, 10), (12, None, 10)], "h int, m int, p int").select(hit, miss).collect()
    assert [tuple(r) for r in got] == [(3, 7), (0, 0), (3, 1), (12, 0)]


def test_paragraphs_are_trimmed_of_blanks_only(spark):
    found = spark.createDataFrame([("0a0 \n 1b1\n\n  \n2c2",)], "t string").select(T.paragraphs(F.col("t")).alias("p")).first().p
    assert found == ["0a0", "1b1", "2c2"]
