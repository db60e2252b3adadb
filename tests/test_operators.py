import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from weft.operators import aggregates, budget, cleaning, dedup, dictionary, graph, intervals, joins, retrieval, sequences, upsert, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_latest_and_pairs(spark):
    log = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 1, "y"), ("b", 1, 1, None)], "k string, at int, seq int, v string")
    assert rows(aggregates.latest(log, ["k"], ["at", "seq"]).select("k", "v")) == [("a", "y"), ("b", None)]
    items = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "y"), (2, "x"), (3, "z")], "g int, i string")
    assert rows(aggregates.pair_counts(items, "g", "i")) == [("x", "y", 2)]


def test_runs_and_stitched(spark):
    at = spark.createDataFrame([("u", i) for i in (1, 2, 2, 3, 6, 7, 20)], "k string, at int")
    assert rows(windows.runs(at, ["k"], "at").drop("k")) == [(1, 1, 3, 3), (2, 6, 7, 2), (3, 20, 20, 1)]
    assert rows(windows.runs(at, ["k"], "at", 3).drop("k")) == [(1, 1, 7, 5), (2, 20, 20, 1)]
    segments = windows.runs(at, ["k"], "at")
    assert rows(windows.clusters(segments, ["k"], 5).drop("k")) == [(1, 1, 7, 2, 5), (2, 20, 20, 1, 1)]


def test_run_lengths_with_nulls(spark):
    s = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "o int, s string").withColumn("k", F.lit(0))
    assert rows(windows.run_lengths(s, ["k"], ["o"], "s").drop("k"), "run") == [(1, "a", 2), (2, None, 2), (3, "a", 1)]


def test_changes_treat_blank_as_null(spark):
    t = spark.createDataFrame([(1, "", 0), (2, None, None), (3, "x", 0), (4, "x", 5)], "o int, a string, b int").withColumn("k", F.lit(1))
    assert [(r.o, r.changed) for r in windows.changes(t, ["k"], ["o"], ["a", "b"]).orderBy("o").collect()] == [(3, ["a"]), (4, ["b"])]


def test_best_overlap_across_buckets(spark):
    left = spark.createDataFrame([("s", 1, 0, 100), ("s", 2, 500, 510), ("t", 3, 0, 5)], "k string, id long, lo long, hi long")
    right = spark.createDataFrame([("s", 7, 90, 95), ("s", 8, 10, 60), ("s", 9, 20, 70), ("t", 5, 6, 9)], "k string, rid long, rlo long, rhi long")
    assert rows(joins.best_overlap(left, right, "k", 16)) == [(1, 8, 51)]


def test_lookup_order_and_contained(spark):
    ask = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    a = spark.createDataFrame([(1, "one")], "id int, v string")
    b = spark.createDataFrame([(1, "uno"), (2, "dos")], "id int, v string")
    assert rows(joins.lookup(ask, "id", [a, b], ["v"])) == [(1, "one", 0), (2, "dos", 1)]
    texts = spark.createDataFrame([(1, "xx the quick brown fox jumps"), (2, "the quick brown"), (3, None)], "id int, text string")
    phrases = spark.createDataFrame([(7, "he quick brown fox j"), (8, "too short")], "pid int, phrase string")
    assert rows(dictionary.contained(texts, phrases).select("id", "pid")) == [(1, 7)]


def test_contained_phrases_of_any_length(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "ca b", "a\nb"]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None, ""]
    phrases = [" ".join(rng.choice(["ab", "abc", "b", "c"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6) for _ in range(4)] + ["", "b", "b", None, " ab", "ca b ab ab"]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    right = spark.createDataFrame(list(enumerate(phrases)), "pid int, phrase string")
    want = sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if t is not None and p is not None and p in t)
    for way in (dictionary.contained, dictionary.anchored):
        assert rows(way(left, right).select("id", "pid"), "id", "pid") == want and len(want) > 100


def test_marks_and_neighbours(spark):
    t = spark.createDataFrame([(i, None if i % 5 == 0 else "x" if i % 2 else "y", "g" if i < 30 else None) for i in range(40)], "id long, f string, g string")
    got = dedup.mark(t, F.col("f"), ["id"], ["g"]).collect()
    groups = {}
    for r in t.collect():
        groups.setdefault((r.f, r.g), []).append(r.id)
    assert sorted((r.id, r.n_copies, r.keep) for r in got) == sorted((i, len(own), i == min(own)) for own in groups.values() for i in own)
    ids = sorted(random.Random(5).sample(range(200), 60))
    places = spark.createDataFrame([(i, "a" if i % 3 else None) for i in ids], "at long, g string")
    for width in (1, 7, 1000):
        found = {r.at: r.next for r in intervals.with_next(places, "g", "at", width).collect()}
        for side in ([i for i in ids if i % 3], [i for i in ids if i % 3 == 0]):
            assert [found[i] for i in side] == [*side[1:], None]


def test_percentiles_of_counts(spark):
    rng = random.Random(7)
    data = [("a", rng.randrange(9)) for _ in range(57)] + [("b", 4), ("c", None), ("a", None)]
    got = {r.k: r for r in aggregates.index_percentiles(spark.createDataFrame(data, "k string, v int"), "k", "v", {"low": 0.1, "mid": 0.5, "high": 0.9}).collect()}
    a = sorted(v for k, v in data if k == "a" and v is not None)
    assert tuple(got["a"])[1:] == (57, a[0], a[-1], a[5], a[28], a[51]) and tuple(got["b"])[1:] == (1, 4, 4, 4, 4, 4) and tuple(got["c"])[1:] == (0, None, None, None, None, None)


def test_long_chains_are_one_cluster(spark):
    n = 300
    nodes = spark.range(n)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 200], "a long, b long")
    got = {r.id: r.cluster for r in dedup.single_link(pairs, nodes).collect()}
    assert got == {i: 0 if i <= 200 else 201 for i in range(n)}


def test_both_known(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "a"), (1, "a", "z"), (1, "a", "b")], "g int, x string, y string")
    cast = spark.createDataFrame([(1, "a"), (1, "b")], "g int, n string")
    assert rows(joins.both_known(edges, cast, "g", ("x", "y"), "n")) == [(1, "a", "b")]


def test_merge_identical_and_single_link(spark):
    t = spark.createDataFrame([(1, "a b", "s2"), (2, "ab", "s1"), (3, "c", "s1")], "o int, text string, s string")
    assert rows(dedup.merge_identical(t, "text", "s", "o"), "text") == [("a b", ["s2", "s1"], 2), ("c", ["s1"], 1)]
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id int")
    pairs = spark.createDataFrame([(5, 4), (4, 3), (1, 0)], "a int, b int")
    assert rows(dedup.single_link(pairs, nodes), "id") == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 3)]


def test_same_meaning(spark):
    t = spark.createDataFrame([("Red door!", "red DOOR"), ("the red door", "red door"), ("a stranger at the gate", "a stranger at the gates"), ("abc", "abcdefgh"), ("one thing here now", "another matter then")], "a string, b string")
    assert [r[0] for r in t.select(dedup.same_meaning(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]


def test_tails(spark):
    base = [f"A quite long paragraph number {i} about {'abcdefgh'[i] * 9}." for i in range(6)]
    t = spark.createDataFrame([(1, "\n".join(base + base[:3])), (2, "\n".join(base)), (3, None)], "id int, text string")
    assert rows(dedup.without_repeated_tail(t, "text").select("id", "n_cut")) == [(1, 3), (2, 0), (3, 0)]
    t = spark.createDataFrame([(1, "Story.\nAd: buy\nLicensed under X"), (2, "Story.\nAd: buy"), (3, "")], "id int, text string")
    assert rows(cleaning.without_tail_block(t, "text", "Licensed", "^Ad")) == [(1, "Story.", 2), (2, "Story.\nAd: buy", 0), (3, "", 0)]


def test_line_rules(spark):
    t = spark.createDataFrame([("",), ("Licensed under MIT",), ("https://a.b/c",), ("*****",), ("body text",), ("--- !!",)], "l string")
    assert [r[0] for r in t.select(cleaning.line_class(F.col("l"))).collect()] == ["blank", "licence", "link", "rule", "body", "junk"]
    text, hits = cleaning.inline(F.lit("see https://x.y a@b.cc ### &amp; end"))
    got = spark.range(1).select(text.alias("t"), *(n.alias(k) for k, n in hits.items())).first()
    assert got.t == "see     end" and (got.mail, got.link, got.symbols, got.entity) == (1, 1, 1, 1)


def test_chunks_and_batches(spark):
    assert intervals.pack_paragraphs(["a" * 300, "b" * 300, "c" * 1200], 500) == ["a" * 300, "b" * 300, "c" * 500, "c" * 500, "c" * 200]
    assert intervals.pack_paragraphs([], 500) == []
    t = spark.createDataFrame([("s", i, n) for i, n in enumerate([50, 500, 20, 20, 20, 20])], "k string, o int, n int")
    assert [r.batch for r in intervals.batches(t, "k", "o", "n", 3, 100).orderBy("o").collect()] == [0, 1, 2, 2, 2, 3]


def test_partition_repair():
    assert intervals.repair([(3, 5), (4, 8), (11, 30)], 1, 20) == [(1, 5), (6, 10), (11, 20)]
    assert intervals.repair([], 1, 9) == [(1, 9)]
    assert intervals.repair([(5, 4), (50, 60)], 1, 9) == [(1, 9)]


def test_cuts_coverage_windows(spark):
    cuts = spark.createDataFrame([("b", 1, 30), ("b", 11, 30), ("b", 25, 30)], "k string, c int, last int")
    assert rows(intervals.from_cuts(cuts, "k", "c", "last")) == [("b", 1, 10), ("b", 11, 24), ("b", 25, 30)]
    assert rows(intervals.coverage(spark.createDataFrame([("b", 1, 5), ("b", 4, 6)], "k string, lo int, hi int"), "k")) == [("b", 6, 2)]
    assert rows(intervals.windows(spark.createDataFrame([("b", 1, 25)], "k string, first int, last int"), 10, 5).drop("k", "first", "last")) == [(1, 10, 15), (11, 20, 25), (21, 25, 25)]


def test_sequences(spark):
    a, b = list("abcbdab"), list("bdcaba")
    n, s = sequences.common_length(a, b), sequences.supersequence(a, b)
    assert n == 4 and len(s) == len(a) + len(b) - n
    for x in (a, b):
        it = iter(s)
        assert all(c in it for c in x)
    assert sequences.mergeable(list("abc"), list("abd")) and not sequences.mergeable(list("ab"), list("cd")) and not sequences.mergeable([], list("a"))
    t = spark.createDataFrame([(1, 1, list("abc")), (1, 2, list("xyz")), (1, 3, list("abd")), (1, 4, [])], "k int, o int, s array<string>")
    assert [r.cluster for r in sequences.clustered(t, "k", "o", "s").orderBy("o").collect()] == [0, 1, 0, 2]


def test_merged_is_shortest_and_keeps_repeats():
    rng = random.Random(2)
    for _ in range(150):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(6))] for _ in range(2))
        ta, tb = [rng.randrange(1, 4) for _ in a], [rng.randrange(1, 4) for _ in b]
        best = {(0, 0): 0}  # breadth first over places of both
        todo = [(0, 0)]
        for i, j in todo:
            for s in set(a[i : i + 1] + b[j : j + 1]):
                to = i + (a[i : i + 1] == [s]), j + (b[j : j + 1] == [s])
                if to not in best:
                    best[to] = best[i, j] + 1
                    todo.append(to)
        s, t = sequences.merged(a, b, ta, tb)
        assert len(s) == len(t) == best[len(a), len(b)] == len(a) + len(b) - sequences.common_length(a, b)
        for x in (a, b):
            assert None not in sequences.positions(x, s)
        assert sum(t) <= sum(ta) + sum(tb) and all(n in ta + tb for n in t)
    assert sequences.merged("abc", "bcd", [1, 5, 1], [2, 1, 9]) == (list("abcd"), [1, 5, 1, 9])
    assert sequences.positions("bxd", "abcd") == [1, None, None] and sequences.positions("bd", "abcd") == [1, 3]


def test_outcomes():
    kind = lambda a, b, **more: sequences.outcome(a, b, **more)[0]
    assert sequences.outcome("abcdef", "acdg") == ("merge", 0.75) and kind("abcdefg", "a") == "apart" and kind("abcdefghijkl", "abcm") == "apart"
    assert kind("ahf", "agf") == "merge" and kind("ahf", "agf", short=0.7) == "apart"
    assert kind("abcdefghij", "abcdez") == "apart" and kind("abcdefghij", "abcdefz") == "merge"
    assert kind("abcdefghijklmnop", "bdf") == "attach" and kind("abcdefghijklmnop", "bdx") == "apart" and kind("abcdefghijklmno", "bdfz") == "apart"
    assert kind("abc", "abd", cores="c") == "apart" and kind("abd", "abc", cores="ab") == "merge"


def test_agglomerate_best_first():
    long = list("abcdefghijklmnop")
    assert sequences.agglomerate([list("abcx"), list("abyz"), list("abcd"), list("abcd")]) == ([0, 1, 0, 0], [False] * 4)
    assert sequences.agglomerate([long, list("bdf"), list("bdx")]) == ([0, 0, 1], [False, True, False])
    rng = random.Random(4)
    for _ in range(30):
        data = [[rng.choice("abcdef") for _ in range(rng.randrange(1, 6))] for _ in range(8)]
        groups = [([*s], [i]) for i, s in enumerate(data)]
        while True:  # all pairs again after each step
            found = [(-sequences.outcome(a, b)[1], i, j) for i, (a, _) in enumerate(groups) for j, (b, _) in enumerate(groups) if i < j and sequences.outcome(a, b)[0] == "merge"]
            if not found:
                break
            _, i, j = min(found)
            groups[i] = (sequences.supersequence(groups[i][0], groups[j][0]), groups[i][1] + groups[j][1])
            del groups[j]
        want = {i: n for n, (_, own) in enumerate(groups) for i in own}
        assert sequences.agglomerate(data)[0] == [want[i] for i in range(8)]


def test_nearest_filters_tenant_first(spark):
    unit = lambda i: [float(i == j) for j in range(4)]
    base = spark.createDataFrame([("mine", i, unit(i)) for i in range(3)] + [("other", 100 + i, unit(0)) for i in range(50)] + [("mine", 9, [1.0])], "tenant string, row_id int, vector array<float>")
    ask = spark.createDataFrame([(0, "mine", [1.0, 0.1, 0.0, 0.0])], "query_id int, tenant string, vector array<float>")
    assert [r.row_id for r in retrieval.nearest(ask, base, 2, tenant="tenant").orderBy("rank").collect()] == [0, 1]
    assert retrieval.nearest(ask.limit(0), base, 2, tenant="tenant").count() == 0


def test_fusion_and_tiers(spark):
    one = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    two = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    got = {r.id: r.score for r in retrieval.fused([one, two], ["id"]).collect()}
    assert max(got, key=got.get) == 2 and abs(got[1] - 1 / 61) < 1e-12
    items = spark.createDataFrame([(1, "x"), (2, "a"), (3, "ab")], "pos int, c string").withColumn("q", F.lit(0))
    assert [r.pos for r in retrieval.tiers(items, ["q"], "pos", F.col("c") == "ab", F.col("c").startswith("a")).orderBy("new_rank").collect()] == [3, 2, 1]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "k", 60), ("c", "a", "k", 90), ("a", "d", "m", None), ("b", "c", "k", 10)], "a string, b string, kind string, weight int")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.expand(seeds, edges, {"k": 1}).select("node", "other", "rank")) == [("a", "c", 1)]
    assert [tuple(r) for r in graph.touching(edges, seeds, 2).select("a", "b").collect()] == [("c", "a"), ("a", "b")]
    assert rows(graph.without(edges, seeds).select("a", "b")) == [("b", "c")]


def test_upserts(spark):
    table = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert rows(upsert.upsert(table, new, ["k"], ["o"])) == [(1, "y"), (2, "keep"), (3, "z")]
    assert rows(upsert.insert_absent(table, new, ["k"], ["o"])) == [(1, "old"), (2, "keep"), (3, "z")]
    tables = {"p": spark.createDataFrame([(1,), (2,)], "id int"), "c": spark.createDataFrame([(10, 1), (20, 2)], "id int, p int"), "g": spark.createDataFrame([(10,), (20,), (20,)], "c int")}
    left = upsert.cascade(tables, tables["p"].where("id = 2"), "id", [("p", "id", "c", "p"), ("c", "id", "g", "c")])
    assert [left[t].count() for t in ("p", "c", "g")] == [1, 1, 1]


def test_as_of_and_lifecycle(spark):
    e = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    s = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, at int, v string")
    assert rows(upsert.as_of(e, s, "k", "at", "v")) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]
    acts = spark.createDataFrame([("p", 1, "bury", "The Ring"), ("p", 2, "hint", "the ring!"), ("p", 3, "resolve", "THE RING"), ("p", 4, "resolve", "sword"), ("p", 5, "bury", "the ring")], "k string, no int, action string, what string")
    got = {r.what: (r.status, r.opened, r.hints, r.closed, r.orphans) for r in upsert.lifecycle(acts, "k", ["no"]).collect()}
    assert got == {"The Ring": ("done", 1, 1, 3, 0), "sword": ("none", None, 0, None, 1)}


def test_lifecycle_of_paraphrases(spark):
    acts = [
        (1, "bury", "The old bronze key under the altar"), (2, "bury", "A stranger watches the northern gate"),
        (3, "hint", "the old bronze key"), (4, "hint", "The old bronze keys under an altar"), (5, "bury", "the old bronze key under that altar"),
        (6, "resolve", "A stranger watches the northern gates."), (7, "hint", "Stranger watches the northern gate"), (8, "bury", "a stranger watched the northern gate"),
        (9, "bury", "key"), (10, "hint", "keys"), (11, "bury", "the silver bell tolls"), (12, "bury", "silver bell of the tower"), (13, "resolve", "the silver bell tolls, silver bell of the tower"),
    ]
    acts = spark.createDataFrame([("p", *a) for a in acts], "k string, no int, action string, what string")
    got = {r.what: (r.status, r.opened, r.hints, r.closed, r.orphans) for r in upsert.lifecycle(acts, "k", ["no"]).collect()}
    assert got == {
        "The old bronze key under the altar": ("pending", 1, 2, None, 0),
        "A stranger watches the northern gate": ("done", 2, 0, 6, 1),
        "key": ("pending", 9, 0, None, 0), "keys": ("none", None, 0, None, 1),
        "the silver bell tolls": ("pending", 11, 0, None, 0), "silver bell of the tower": ("done", 12, 0, 13, 0),
    }


def test_budget(spark):
    blocks = spark.createDataFrame([("q", "a", 500, True, 0), ("q", "b", 400, False, 9), ("q", "c", 300, False, 5), ("q", "d", 50, False, 1)], "k string, name string, size long, required boolean, priority int")
    assert [(r.name, r.decision, r.taken) for r in budget.plan(blocks, "k", 1000, 200).orderBy("name").collect()] == [("a", "kept", 500), ("b", "kept", 400), ("c", "dropped", 0), ("d", "kept", 50)]


def test_tail_bounds_are_those_of_difflib():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice(["ab", "abcd", "abcdefgh \U0001f600é"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in "ab")
        b = "".join(c for c in a if rng.random() < 0.9) + b[:5] if rng.random() < 0.5 else b
        blocks = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        common = sequences.common_length(a, b)
        assert dedup._matching(a, b) == blocks <= common
        assert dedup._common_lengths(a, [b, "", a]).tolist() == [common, 0, len(a)]


def test_tails_of_long_paragraphs_take_seconds(spark):
    rng = random.Random(6)
    long = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(20_000)) for _ in range(8)]
    edited = [p[:900] + "Z" + p[902:] for p in long[:3]]
    t = spark.createDataFrame([(1, "\n".join(long)), (2, "\n".join(long + edited))], "id int, text string").coalesce(1)
    began = time.monotonic()
    assert rows(dedup.without_repeated_tail(t, "text").select("id", "n_cut")) == [(1, 0), (2, 3)]
    assert time.monotonic() - began < 60
