"""Arcs of a live stream: agreement with the finished table under shuffled and replayed batches, missing and late places."""

import datetime
import random

from tests.conftest import DATA
from weft.catalog import stream
from weft.catalog.tables import read
from weft.streaming import arcs


def plainly(cuts, last, gap, least):
    groups = []
    for c in sorted(cuts):
        if groups and c - groups[-1][-1] <= gap:
            groups[-1].append(c)
        else:
            groups.append([c])
    out, lo = [], 1
    for g in groups:
        at = g[len(g) // 2]
        if at - lo >= least:
            out.append((lo, at - 1))
            lo = at
    return [*out, (lo, last)]


def test_fold_is_its_definition():
    rng = random.Random(1)
    for _ in range(300):
        last, gap, least = rng.randrange(1, 40), rng.randrange(1, 5), rng.randrange(1, 8)
        cuts = {p for p in range(1, last + 1) if rng.random() < 0.3}
        places = list(range(1, last + 1))
        rng.shuffle(places)
        reader, out = arcs.Reader(gap, least), []
        for p in places + places[:5]:
            reader = arcs.Reader(gap, least, reader.state())  # as from the store
            out += reader.come(p, p in cuts) + reader.read()
        out += reader.end()
        assert out == [("arc", *x) for x in plainly(cuts, last, gap, least)]


def test_missing_and_late_places():
    reader = arcs.Reader(1, 2)
    assert reader.come(4, False) + reader.read() == [] and reader.give_up() == [("missing", 1, 3)]
    assert reader.next == 5 and reader.come(2, True) == [("late", 2, 2)] and reader.come(2, True) == []
    assert reader.end() == [("arc", 1, 4)]


def test_registered_arcs(spark):
    from pyspark.sql import functions as F

    rows = read(spark, DATA, "documents").select(F.coalesce("lang", F.lit("")).alias("source"), "doc_id", F.col("text").rlike("(?i)licen[sc]ed under|https?://").alias("cut")).orderBy("doc_id").collect()
    books = {}
    for r in rows:
        books.setdefault(r.source, []).append(bool(r.cut))
    want = {(b, "arc", *x) for b, cuts in books.items() for x in plainly({i for i, c in enumerate(cuts, 1) if c}, len(cuts), 2, 5)}
    assert {tuple(r) for r in stream.live_arcs(spark, DATA).collect()} == want and len(want) > len(books)


def run_stream(spark, tmp_path, batches, **kw):
    schema = "book string, place long, cut boolean, ts timestamp"
    out, source = [], tmp_path / "in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([], schema).write.parquet(str(source))
    live = arcs.live_arcs(spark.readStream.schema(schema).parquet(str(source)), 2, 4, **kw)
    begin = lambda: live.writeStream.foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query = begin()  # a restart for each batch
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out


def test_stream_agrees_with_the_table(spark, tmp_path):
    rng = random.Random(2)
    now = datetime.datetime(2024, 1, 1)
    rows = [(b, p, rng.random() < 0.25, now) for b, n in (("a", 60), ("b", 25)) for p in range(1, n + 1)]
    shuffled = rng.sample(rows, len(rows))
    found = run_stream(spark, tmp_path, [shuffled[:50], shuffled[40:70], shuffled[60:]])
    whole = arcs.arcs_of(spark.createDataFrame(rows, "book string, place long, cut boolean, ts timestamp"), 2, 4)
    want = sorted(map(tuple, whole.collect()))
    last = {b: max(w for w in want if w[0] == b) for b in "ab"}  # what only the end of a book settles
    assert set(found) <= set(want) and len(found) == len(set(found))
    assert {w for w in want if w[3] < last[w[0]][2] - 4} <= set(found) and len(found) > 3


def test_stream_gives_up_and_tells_of_late_places(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    batches = [[("a", p, False, at(0)) for p in (1, 2, 5, 6)], [("b", 1, False, at(5))], [("b", 2, False, at(9))], [("a", 3, True, at(9)), ("b", 3, False, at(12))]]
    found = run_stream(spark, tmp_path, batches, patience_ms=3_600_000, late="1 hour")
    assert [x for x in found if x[1] != "arc"] == [("a", "missing", 3, 4), ("a", "late", 3, 3)]
