"""Records, cuts, assignments and gates on literal rows and against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from weft.functions import predicates
from weft.functions import text as T
from weft.operators import cleaning, graph, intervals, joins, retrieval, upsert, windows
from tests.conftest import DATA
from weft import catalog, registry  # noqa: F401


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_kept_cuts():
    assert intervals.kept_cuts([], 1, 9, 8) == [] and intervals.kept_cuts([5], 1, 30, 8) == [] and intervals.kept_cuts([9, 17], 1, 30, 8) == [9, 17]
    rng = random.Random(1)
    for _ in range(200):
        cuts, last = [rng.randrange(-3, 60) for _ in range(rng.randrange(12))], rng.randrange(1, 50)
        kept = intervals.kept_cuts(cuts, 1, last, 8)
        edges = [1, *kept, last + 1]
        assert set(kept) <= set(cuts) and (not kept or min(b - a for a, b in itertools.pairwise(edges)) >= 8)


def test_clusters_and_stitched(spark):
    cuts = spark.createDataFrame([("a", x) for x in (10, 12, 14, 15, 40, 41, 60, None)] + [("b", 3)], "k string, c int")
    assert rows(intervals.cut_clusters(cuts, "k", "c", 4)) == [("a", 14), ("a", 41), ("a", 60), ("b", 3)]
    spans = spark.createDataFrame([("a", 1, 62), ("b", 1, 30), ("c", 5, 6)], "k string, first int, last int")
    arcs = intervals.stitched(cuts, spans, "k", "c")
    assert rows(arcs) == [("a", 1, 13), ("a", 14, 40), ("a", 41, 62), ("b", 1, 30), ("c", 5, 6)]
    assert rows(intervals.arc_report(arcs, "k", 8, 25)) == [("a", 3, 62 / 3, 0, 1, 62), ("b", 1, 30.0, 0, 1, 30), ("c", 1, 2.0, 1, 0, 2)]


def test_stitched_query(spark):
    got = registry.QUERIES["stitched_arcs"](spark, DATA).collect()
    assert got and all(r.covered == r["last"] - r["first"] + 1 and (r.short == 0 or r.arcs == 1) for r in got)


def test_assigned(spark):
    rng = random.Random(3)
    data = [(k, s, c, rng.randrange(5) / 4) for k in "xy" for s in range(4) for c in range(5) if rng.random() < 0.8]
    got = rows(retrieval.assigned(spark.createDataFrame(data, "k string, s int, c int, v double"), "k", "s", "c", "v"))
    want = []
    for k in "xy":
        left = [d for d in data if d[0] == k]
        while left:  # the best of all that are left, again and again
            best = min(left, key=lambda d: (-d[3], d[1], d[2]))
            want.append(best)
            left = [d for d in left if d[1] != best[1] and d[2] != best[2]]
    assert got == sorted(want)


def test_assignment_query(spark):
    got = registry.QUERIES["slot_assignment"](spark, DATA).toPandas()
    assert len(got) and not got.duplicated(["l_orderkey", "slot"]).any() and not got.duplicated(["l_orderkey", "candidate"]).any()


def test_replaced_and_restored(spark):
    chunks = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("c", 0, "z")], "s string, i int, t string")
    new = spark.createDataFrame([("b", 0, "p"), ("b", 1, "q"), ("d", 0, "r"), ("e", 0, "gone")], "s string, i int, t string")
    live = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "s string")
    assert rows(upsert.replaced(chunks, new, live, "s")) == [("a", 0, "x"), ("b", 0, "p"), ("b", 1, "q"), ("d", 0, "r")]
    revisions = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 5, "c"), ("l", 1, "x")], "k string, n int, v string")
    assert rows(upsert.restored(revisions, "k", "n", 1, ["v"])) == [("k", 6, 2, "b")]


def test_resolved(spark):
    ask = spark.createDataFrame([("Anna",), ("Old Anna",), ("Bo",), ("xBo",), (None,), ("Anna",)], "name string")
    tables = {"p": spark.createDataFrame([("Anna", 1), ("Hanna", 2), ("Bo", 3)], "name string, id int"), "q": spark.createDataFrame([("Anna", 4)], "name string, id int")}
    assert rows(joins.resolved(ask, tables)) == [("Anna", "p", 1, True), ("Anna", "q", 4, True), ("Bo", "p", 3, True), ("Old Anna", "p", 2, False)]


def test_trailing_and_sampled(spark):
    t = spark.createDataFrame([("a", 0, 1), ("a", 59, 2), ("a", 60, 4), ("a", 61, 8), ("b", 61, 16)], "k string, s long, n int").withColumn("at", F.timestamp_seconds("s"))
    assert [r.used for r in windows.trailing(t, ["k"], "at", 60, "n", "used").orderBy("k", "s").collect()] == [1, 3, 7, 14, 16]
    many = spark.createDataFrame([("a", i) for i in range(11)] + [("b", 1)], "k string, i int")
    assert rows(windows.every_nth(many, ["k"], ["i"], 3)) == [("a", 0), ("a", 3), ("a", 6), ("b", 1)]


def test_gates(spark):
    t = spark.createDataFrame([("It was: a dark, stormy night.", "a dark...stormy NIGHT"), ("It was", "it is"), ("abc", ""), (None, "abcd"), ("abcd", "ab...cd")], "t string, e string")
    assert [r[0] for r in t.select(predicates.grounded(F.col("e"), F.col("t"))).collect()] == [True, False, False, False, False]
    s = spark.createDataFrame([("a long enough summary",), ("{a long enough summary",), ("short",), (None,)], "t string")
    assert [r[0] for r in s.select(predicates.summary_like(F.col("t"))).collect()] == [True, False, False, False]
    p = spark.createDataFrame([("dead", 1), ("?", 69), ("?", 70), ("alive", None)], "s string, seen int")
    assert [r[0] for r in p.select(predicates.state_of(F.col("s"), F.col("seen"), F.lit(100), ["dead", "alive"])).collect()] == ["dead", "dormant", "alive", "alive"]


def test_injected_blocks(spark):
    lines = ["body one", "https://a.b", "body two", "### ad", "copyright x", "tail"]
    t = spark.createDataFrame([(1, "\n".join(lines)), (2, "clean"), (3, None), (4, "Licensed under X\nrest")], "id int, text string")
    found = cleaning.injected(t, "id", "text", "(?i)licensed under", r"(?i)copyright|https?://|[#]{3}")
    got = {r.id: r for r in found.withColumn("d", cleaning.injection_decision(F.col("cut"), F.col("share"))).collect()}
    assert {i: (r.cut, r.tail, r.body, r.d) for i, r in got.items()} == {1: (4, 21, 27, "tail"), 2: (None, 0, 5, "none"), 4: (1, 20, 0, "whole")}
    cut = t.join(found, "id").select("id", cleaning.before_line(F.col("text"), F.col("cut")))
    assert rows(cut, "id") == [(1, "\n".join(lines[:3])), (2, "clean"), (4, "")]


def test_texts_and_lists(spark):
    t = spark.createDataFrame([("see\n [[load: a,, b ]]\nend",), ("none",), (None,), ("[[load:]]",)], "t string")
    assert rows(t.select(T.load_ids(F.col("t")), T.without_commands(F.col("t"))), F.monotonically_increasing_id()) == [(["a", "b"], "see\nend"), (None, "none"), (None, None), ([], "")]
    b = spark.createDataFrame([("a×3",), ("b × 12 ",), ("c",), ("×",)], "t string")
    assert rows(b.select(*T.beat(F.col("t"))), F.monotonically_increasing_id()) == [("a", 3), ("b", 12), ("c", 1), ("×", 1)]
    p = spark.createDataFrame([("a； b\n;c",), (None,)], "t string")
    assert rows(p.select(T.as_list(F.col("t"))), F.monotonically_increasing_id()) == [(["a", "b", "c"],), ([],)]
    assert rows(spark.createDataFrame([("****x ",), ("***x",)], "t string").select(T.behind_stars(F.col("t"))), F.monotonically_increasing_id()) == [("x",), (None,)]


def test_aliases_edges_ledgers(spark):
    a = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A"), ("y", "A"), ("Bo", "A")], "alias string, owner string")
    roster = spark.createDataFrame([("Bo",)], "name string")
    assert rows(joins.alias_decisions(a, roster)) == [("Bo", "A", "propose"), ("x", "A", "conflict"), ("y", "A", "merge")]
    edges = spark.createDataFrame([("g", "m", "has"), ("g", "l", "leads"), ("h", "m", "has")], "a string, b string, kind string")
    groups = spark.createDataFrame([("g", ["n", None, "g", "n"])], "node string, members array<string>")
    assert rows(graph.rebuilt(edges, groups, "has")) == [("g", "l", "leads"), ("g", "n", "has"), ("h", "m", "has")]
    old = spark.createDataFrame([("d", 1, "aaaa"), ("d", 2, "bb"), ("d", 3, "c")], "d string, n int, t string")
    new = spark.createDataFrame([("d", 3, "cccc"), ("d", 4, "dd")], "d string, n int, t string")
    assert rows(upsert.ledger(old, new, ["d"], "n", "t", 8)) == [("d", 2, "bb"), ("d", 3, "cccc"), ("d", 4, "dd")]
    left = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, o int, v string")
    assert rows(joins.paired(left, left.where("o = 1"), "k", ["o"], "v")) == [("k", 1, "a", "a", True), ("k", 2, "b", None, False)]


def test_numbered_and_dispatched(spark):
    rng = random.Random(9)
    ids = rng.sample(range(-50, 300), 120)
    t = spark.createDataFrame([(i, [None, "a", "b"][i % 3], i % 2 == 0, i % 7) for i in ids], "id long, k string, f boolean, p int")
    for width in (1, 13, 10_000):
        got = {r.id: r.n for r in windows.numbered(t, ["k", "f"], "id", "n", width).collect()}
        assert got == {i: sum((j % 3, j % 2) == (i % 3, i % 2) and j <= i for j in ids) for i in ids}
    done = windows.dispatch(t, "k", "p", "id", F.coalesce(F.col("k") != "b", F.lit(True))).collect()
    best = {k: min((-(i % 7), i) for i in ids if [None, "a", "b"][i % 3] == k)[1] for k in (None, "a", "b")}
    assert all(r.active == (r.k == "b" or r.id == best[r.k]) and r.winner == (None if r.active else best[r.k]) for r in done) and len(done) == 120


def test_assigned_folds_keys_by_the_batch(spark):
    """Thousands of small keys take no Python call each; ties, NaN and nulls have their places."""
    rng = random.Random(4)
    data = [(k, rng.choice("abc"), rng.choice([1, 2, 3, None]), rng.choice([0.0, 1.0, 2.0, float("nan"), None])) for k in range(20_000) for _ in range(3)]
    t = spark.createDataFrame(data, "k int, s string, c int, v double")
    found = retrieval.assigned(t, "k", "s", "c", "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    want = {}
    for k, s, c, v in sorted((d for d in data if d[3] is not None), key=lambda d: (d[0], d[3] != d[3], -d[3] if d[3] == d[3] else 0, d[1], d[2] is None, d[2] or 0)):
        own = want.setdefault(k, [])
        if all(s != x and c != y for x, y, _ in own):
            own.append((s, c, repr(v)))
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append((r.s, r.c, repr(r.v)))
    assert {k: sorted(x, key=str) for k, x in got.items()} == {k: sorted(x, key=str) for k, x in want.items()}
