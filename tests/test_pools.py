"""Pools, owners, references, extracts and tails on literal rows."""

from pyspark.sql import functions as F

from weft.functions import parsing
from weft.functions import text as T
from weft.operators import cleaning, graph, pools, upsert

ENTRY = "id int, name string, aliases array<string>, category string, genre string, status string, reference_only boolean"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def test_only_active_entries_are_seen_and_found(spark):
    items = entries(spark, [(1, "sword", ["blade"], "arms", "x", "active", False), (2, "pill", [], "drugs", "x", "active", True), (3, "blade", None, "arms", "y", "disabled", None), (4, "bow", ["sword"], "arms", "common", "active", None)])
    skills = entries(spark, [(1, "blade", ["dance"], "moves", "x", "active", False)])
    assert {r.id for r in pools.visible(items).collect()} == {1, 4} and {r.id for r in pools.visible(items, ["x"], "arms").collect()} == {1}
    names = spark.createDataFrame([(" sword",), ("blade",), ("dance",), ("pill",), ("nothing",), ("",), (None,), ("blade",)], "name string")
    found = {r.name: (r.kind, r.id) for r in pools.looked_up(names, {"item": items, "skill": skills}).collect()}
    assert found == {"sword": ("item", 1), "blade": ("item", 1), "dance": ("skill", 1), "pill": ("item", 2)}
    block = pools.injection_block(pools.offered(pools.visible(items), "genre", 1), "genre", "T").collect()
    assert {r.genre: r.block for r in block} == {"x": "T\narms: sword", "common": "T\narms: bow"}


def test_owners_must_be_present_and_known(spark):
    found = spark.createDataFrame([(1, "s1", "Ann"), (1, "s2", "Bob"), (2, "s3", " Bob "), (2, "s3", "Bob"), (1, "s4", "Cid"), (3, "s5", None)], "place int, thing string, owner string")
    present = spark.createDataFrame([(1, "Ann"), (1, "Cid")], "place int, name string")
    roster = spark.createDataFrame([("Ann", 7), ("Bob", 9), ("Bob", 8)], "name string, id int")
    assert sorted(map(tuple, graph.owner_edges(found, present, roster, "place", "has").collect())) == [(7, "s1", "has"), (8, "s3", "has")]


def test_references_become_edges_once(spark):
    edges = spark.createDataFrame([("a", "b", "k")], "a string, b string, kind string")
    refs = {"k": spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c"), (None, "c")], "a string, b string"), "m": spark.createDataFrame([("x", "y")], "a string, b string")}
    out, counts = graph.from_references(edges, refs)
    assert sorted(map(tuple, counts.collect())) == [("k", 1, 1), ("m", 1, 0)] and out.count() == 3
    assert {r.made for r in graph.from_references(out, refs)[1].collect()} == {0}


def test_extracts_are_put_in_shape(spark):
    data = [
        '{"characters": [" Ann ", "", null, "Bob"], "foreshadow_actions": [{"action": "bury", "desc": " a "}, {"description": "b"}, "c", {"action": "hint"}, ""], "new_entities": [{"name": "S", "kind": "Item", "owner": " Ann "}, {"name": "T", "kind": "dream"}, {"kind": "item"}, {"name": "U"}]}',
        '{"characters": "Ann；Bob\\nCid"}',
        "{}",
        None,
    ]
    t, d = spark.createDataFrame(list(enumerate(data)), "id int, d string"), F.col("d")
    rows = t.select("id", parsing.text_list(d, "characters").alias("c"), parsing.actions(d, "foreshadow_actions").alias("a"), parsing.entities(d, "new_entities", ["item", "character"]).alias("e")).orderBy("id").collect()
    assert [r.c for r in rows] == [["Ann", "Bob"], ["Ann", "Bob", "Cid"], [], []]
    assert [tuple(x) for x in rows[0].a] == [("bury", "a"), ("hint", "b"), ("hint", "c")] and rows[2].a == []
    assert [tuple(x) for x in rows[0].e] == [("item", "S", "Ann"), ("character", "U", None)]


def test_tails_are_cut_if_short(spark):
    texts = ["A story, http://x", "A story http://" + "y" * 80, "http://x", "no noise", "one. http://a http://b", None]
    found = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "id int, t string").orderBy("id").select(cleaning.trimmed_tail(F.col("t"), "https?://").alias("x")).collect()]
    assert found == ["A story.", None, None, None, "one.", None]


def test_restarts_and_renames(spark):
    rows = spark.createDataFrame([("a", 10, 8), ("a", 11, 9), ("a", 12, 11), ("a", 300, 4), ("a", 13, None), ("b", 1, None)], "book string, seq int, no int")
    assert {(r.book, r.seq): (r.usual, r.restarted) for r in cleaning.restarts(rows, "book", "seq", "no", 100).collect()} == {("a", 10): (2, False), ("a", 11): (2, False), ("a", 12): (2, False), ("a", 300): (2, True), ("a", 13): (2, False), ("b", 1): (None, False)}
    names = spark.createDataFrame([(1, "a\x07b"), (2, "a\x01b"), (3, "x\x02y"), (4, "xy"), (5, "fine  name"), (6, "\x03"), (7, "p\x7f  q"), (8, None)], "id int, n string")
    assert sorted((r.id, r.new, r.state) for r in cleaning.renames(names, "id", "n").collect()) == [(1, "ab", "rename"), (2, "ab", "taken"), (3, "xy", "taken"), (7, "p q", "rename")]


def test_transitions_in_order(spark):
    allowed = {"new": ["open"], "open": ["done", "new"], "done": []}
    asked = [(1, 2, "done"), (1, 1, "open"), (1, 3, "open"), (2, 1, "done"), (3, 1, "open"), (3, 2, None), (None, 1, "open")]
    states = spark.createDataFrame([(3, "done"), (4, "open"), (5, None)], "k int, state string")
    found = upsert.transitioned(states, spark.createDataFrame(asked, "k int, seq int, to string"), "k", ["seq"], allowed, "new").collect()
    assert {r.k: (r.state, r.applied, r.rejected) for r in found} == {1: ("done", 2, 1), 2: ("new", 0, 1), 3: ("done", 0, 2), 4: ("open", 0, 0), 5: ("new", 0, 0)}


def test_labelled_texts(spark):
    rows = spark.createDataFrame([("Ann", None, 3), (" ", "x" * 9, None), (None, None, None)], "a string, b string, c int")
    found = [r.x for r in rows.select(T.labelled([("name", F.col("a")), ("", F.col("b")), ("n", F.col("c"))], " | ", 5).alias("x")).collect()]
    assert found == ["name: Ann | n: 3", "xxxxx…", ""]


def test_cleaning_plan(spark):
    from weft.plans import cleaning as plans

    body = "A fine line that ends well.\n" * 3
    texts = {
        1: "Chapter 1\n" + body,
        2: "Chapter 2\n" + body + "Licensed under X\nbuy it now",
        3: "Chapter 3\nshort\nlicensed under X\n" + "foreign words " * 20,
        4: "Chapter 4\n" + body + "and then he",
        500: "Chapter 1\n" + body,
        6: "Chapter 6\n" + body,
        7: None,
    }
    names = {6: "0006\x07 six"}
    rows = spark.createDataFrame([("b", k, names.get(k, f"{k:04}"), t) for k, t in texts.items()], "book string, seq int, name string, text string")
    planned = plans.plan(rows, "seq", "book", "seq", "name", "text", T.first_number(F.col("text")), "(?i)licensed under", "https?://")
    assert {r.seq: (r.action, r.rule, r.cut, r.end) for r in planned.collect()} == {
        1: ("none", "none", None, "clean"), 2: ("A", "tail", 5, "clean"), 3: ("B", "foreign", None, None), 4: ("none", "none", None, "truncated"), 500: ("B", "restart", None, None), 6: ("R", "name", None, "clean"),
    }
    assert tuple(plans.overview(planned, "book").first()) == ("b", 6, 1, 2, 1, 1, 26)
    assert {r.defect: r.places for r in plans.defects(planned, "book", "seq").collect()} == {"tail": [2], "foreign": [3], "restart": [500], "name": [6], "truncated": [4]}
