import json

from pyspark.sql import functions as F

from weft.plans import context
from weft.sources import files
from weft.streaming import events, guard


def test_chapters(spark, tmp_path):
    (tmp_path / "lib" / "bookA").mkdir(parents=True)
    (tmp_path / "lib" / "skip").mkdir()
    for name, raw in (("0001_first one.txt", "Grüße".encode()), ("0003_third.txt", "中文".encode("gb18030")), ("notes.txt", b"x")):
        (tmp_path / "lib" / "bookA" / name).write_bytes(raw)
    (tmp_path / "lib" / "skip" / "0001_x.txt").write_bytes(b"x")
    got = files.chapters(spark, f"file://{tmp_path}/lib", skip=("skip",))
    assert [(r.book, r.no, r.title, r.encoding, r.text) for r in got.orderBy("no").collect()] == [("bookA", 1, "first one", "utf-8", "Grüße"), ("bookA", 3, "third", "gb18030", "中文")]
    one = files.inventory(got).first()
    assert (one.files, one["first"], one["last"], one.missing, one.not_utf8) == (2, 1, 3, 1, 1)


def test_ledger(spark, tmp_path):
    at = f"file://{tmp_path}/ledger"
    files.append_ledger(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), at)
    now = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n")], "k int, v string")
    got = files.reconciled(now, spark.read.parquet(at), "k", "v")
    assert [(r.k, r.state) for r in got.orderBy("k").collect()] == [(2, "changed"), (3, "gone"), (4, "not_in_ledger")]
    files.write_report(now, f"file://{tmp_path}/report", "k", "k", "v")
    assert spark.read.text(f"file://{tmp_path}/report").where("value = '- x'").count() == 1


def test_guard_batch_and_stream_agree(spark, tmp_path):
    loop = "The same long sentence goes round and round for ever. "
    rows = [("a", i, loop) for i in range(8)] + [("b", i, f"Line {i}, unlike {'qwertyuiop'[i] * (20 + i)} the rest. ") for i in range(8)]
    table = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    want = sorted(map(tuple, guard.guarded_batch(table).collect()))
    stopped = [r for r in want if r[3]]
    assert [r[0] for r in stopped] == ["a"] and sum(r[0] == "b" for r in want) == 8 and sum(r[0] == "a" for r in want) < 8
    table.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in")
    q = guard.guarded(stream).writeStream.format("memory").queryName("guarded").option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("guarded").collect())) == want


def test_stream_upsert_and_windows(spark, tmp_path):
    rows = [(1, 1, "a", "2024-01-01 00:10:00"), (1, 2, "b", "2024-01-01 00:50:00"), (2, 1, "c", "2024-01-01 02:00:00")]
    table = spark.createDataFrame(rows, "k int, o int, v string, t string").withColumn("ts", F.to_timestamp("t"))
    table.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in")
    q = events.upserted(stream.select("k", "o", "v"), f"file://{tmp_path}/out", ["k"], ["o"], f"file://{tmp_path}/c1")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out/v0").select("k", "v").collect())) == [(1, "b"), (2, "c")]
    w = events.windowed(stream, "1 hour", [], [F.count("*").alias("n")]).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c2").start()
    w.processAllAvailable()
    w.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
    assert sorted((r.k, r.n) for r in events.sessions(table, "1 hour", "k").collect()) == [(1, 2), (2, 1)]


def test_frames(spark):
    delta = lambda **d: "data: " + json.dumps({"choices": [{"delta": d}]})
    lines = [(1, delta(reasoning_content="hm")), (2, delta(content="hi")), (3, ": ping"), (4, "data: {bad"), (5, "data: [DONE]")]
    got = events.frames(spark.createDataFrame(lines, "id int, line string"), "id", "line")
    assert sorted(map(tuple, got.collect())) == [(1, "thinking", "hm"), (2, "content", "hi"), (5, "done", "")]


def test_context(spark):
    docs = spark.createDataFrame([("g", i, t) for i, t in enumerate(["red fox den", "blue sea", "red fox", "green hill"])], "grp string, name int, text string")
    ask = spark.createDataFrame([(1, "g", "red fox")], "query_id int, grp string, query string")
    got = {r.name: (r.required, r.decision) for r in context.context(docs, ask, "grp", recent=1, relevant=2, characters=30).collect()}
    assert got == {3: (True, "kept"), 2: (False, "kept"), 0: (False, "dropped")} or got == {3: (True, "kept"), 0: (False, "kept"), 2: (False, "kept")}
