"""Evictions, absences, alias chains, logs and plans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.catalog.tables import read
from weft.operators import aliases, budget, cleaning, gaps, replay
from weft.plans import layers
from weft.registry import query

_LINES = "(SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)"


@query("evicted_lines", f"""SELECT conv_id, turn, i, over AND NOT ends AS evicted FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id) - coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 700 AS over, bool_or(first) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
FROM (SELECT conv_id, turn, i, length(line) AS n, sum(length(line)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS level, i = 1 AS first FROM {_LINES}) WINDOW w AS (PARTITION BY conv_id ORDER BY level DESC, turn, i DESC))""")
def evicted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's lines under a budget of 700 characters: turns are its groups."""
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    sized = lines.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("i"), F.length("line").alias("n"))
    return budget.evicted(sized, "conv_id", "turn", "i", "n", 700).drop("n")


_LAST = "(SELECT user_id, user_id % 10 AS book, max(ts) FILTER (WHERE event_type = 'purchase' AND value > 60) AS last FROM events GROUP BY 1)"


@query("reentry_material", f"""WITH u AS {_LAST}, hints AS (SELECT user_id, list(event_id ORDER BY ts, event_id)[1:10] AS l FROM events JOIN u USING (user_id) WHERE event_type = 'signup' AND value > 100 AND (last IS NULL OR ts > last) GROUP BY 1),
world AS (SELECT user_id, list(event_id ORDER BY ts, event_id)[1:10] AS l FROM events JOIN u USING (user_id) WHERE event_type = 'view' AND (last IS NULL OR ts > last) GROUP BY 1),
digest AS (SELECT u.user_id, list(event_id ORDER BY ts, event_id)[1:20] AS l FROM u JOIN events e ON e.user_id % 10 = book AND event_type = 'click' AND (last IS NULL OR ts > last) GROUP BY 1)
SELECT user_id, last, coalesce(h.l, []) AS hints, coalesce(w.l, []) AS world, coalesce(d.l, []) AS digest, CASE WHEN h.l IS NOT NULL THEN 'hints' WHEN w.l IS NOT NULL THEN 'world' WHEN d.l IS NOT NULL THEN 'digest' ELSE 'fallback' END AS priority FROM u LEFT JOIN hints h USING (user_id) LEFT JOIN world w USING (user_id) LEFT JOIN digest d USING (user_id)""")
def reentry_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is to bring a user back with: open hints and own events since the last large purchase (10 of each), and the
    first 20 clicks in the user's book since then."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 10).alias("book"))
    last = F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("ts")))
    users = events.groupBy("user_id", "book").agg(last.alias("last"))
    own = lambda test: gaps.first_behind(users, events.where(test).select("user_id", "ts", "event_id"), "user_id", "last", ["ts", "event_id"], 10)
    clicks = events.where("event_type = 'click'").select("book", "ts", "event_id")
    sources = {"hints": own("event_type = 'signup' and value > 100"), "world": own("event_type = 'view'"), "digest": gaps.group_digest(users, clicks, "user_id", "book", "last", ["ts", "event_id"], 20)}
    return gaps.material(users, sources, "user_id", "event_id").drop("book")


_PAIRS = """(SELECT o_orderkey AS a, coalesce(lag(o_orderkey) OVER w, CASE WHEN o_custkey % 50 = 0 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) END) AS h FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
UNION ALL SELECT o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 97 = 0)"""


@query("alias_closure", f"""WITH RECURSIVE hosts AS MATERIALIZED (SELECT a, min(h) AS h, min(h) <> max(h) AS several FROM {_PAIRS} WHERE h IS NOT NULL AND a <> h GROUP BY 1),
follow AS (SELECT a, h AS pos, 1 AS hops FROM hosts WHERE NOT several UNION ALL SELECT f.a, n.h, f.hops + 1 FROM follow f JOIN hosts n ON n.a = f.pos AND NOT n.several WHERE f.hops < 150),
far AS (SELECT a, max(hops) AS hops, arg_max(pos, hops) AS pos, min(pos) FILTER (WHERE hops > 75) AS low FROM follow GROUP BY 1)
SELECT a AS alias, CASE WHEN hops = 150 THEN low ELSE pos END AS root, CASE WHEN hops < 150 THEN hops END::BIGINT AS hops, CASE WHEN hops = 150 THEN 'cycle' ELSE 'merged' END AS status FROM far UNION ALL SELECT a, a, 0, 'conflict' FROM hosts WHERE several""")
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order stands for its customer's order before; every 50th customer's first one for the last, a cycle; every 97th
    order has a second host."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    by = Window.partitionBy("o_custkey")
    host = F.coalesce(F.lag("o_orderkey").over(by.orderBy("o_orderkey")), F.when(F.col("o_custkey") % 50 == 0, F.max("o_orderkey").over(by)))
    pairs = orders.select(F.col("o_orderkey").alias("alias"), host.alias("host"))
    second = orders.where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("alias"), (F.col("o_orderkey") + 1).alias("host"))
    return aliases.closure(pairs.unionByName(second))


@query("undo_log", "SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, coalesce(max_by(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey <= 5000), 'new') AS status, coalesce(max_by(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey <= 5000), any_value(c_acctbal)) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def undo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, to which every order has written its status and price, taken back to what it was after order 5000."""
    base = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit("new").alias("status"), F.col("c_acctbal").alias("price"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_totalprice")
    rows = orders.join(base, "c_custkey")
    after = F.struct("c_mktsegment", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    log = rows.select("seq", "c_custkey", after.alias("after"), F.struct("c_mktsegment", "status", "price").alias("first"))
    log = log.select("seq", "c_custkey", F.coalesce(F.lag("after").over(Window.partitionBy("c_custkey").orderBy("seq")), "first").alias("before"), "after")
    return replay.table_of(replay.undone(replay.applied(base, log, "c_custkey"), log, "c_custkey", 5000))


_LINKS = r"https?://[^\s<>\"]+"
_ACTION = "CASE WHEN length({0}) < 200 THEN 'short' WHEN regexp_matches({0}, '(?i)licen[sc]ed under') THEN 'licence' WHEN regexp_matches({0}, 'https?://') THEN 'links' END"


@query("plan_drift", f"""WITH p AS (SELECT doc_id, {_ACTION.format('text')} AS action, md5(text) AS d FROM documents), r AS (SELECT doc_id, {_ACTION.format('t')} AS action, md5(t) AS d FROM (SELECT doc_id, regexp_replace(text, 'https?://[^\\s<>"]+', '', 'g') AS t FROM documents))
SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, coalesce(p.action, r.action) AS action, CASE WHEN p.doc_id IS NULL THEN 'unapproved' WHEN r.doc_id IS NULL THEN 'settled' WHEN p.d = r.d THEN 'ready' ELSE 'changed' END AS state FROM (SELECT * FROM p WHERE action IS NOT NULL) p FULL JOIN (SELECT * FROM r WHERE action IS NOT NULL) r ON p.doc_id = r.doc_id AND p.action = r.action""")
def plan_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaning plan made of the documents as they are, after someone has taken the links out of them."""

    def plan(t) -> DataFrame:
        action = F.when(F.length(t) < 200, "short").when(t.rlike("(?i)licen[sc]ed under"), "licence").when(t.rlike("https?://"), "links")
        return read(spark, sf_dir, "documents").select("doc_id", action.alias("action"), F.md5(t).alias("d")).where("action is not null")

    cleaned, _ = cleaning.inline(F.col("text"), (cleaning.Rule("link", _LINKS),))
    return replay.drift(plan(F.col("text")), plan(cleaned), ["doc_id", "action"], "d")


_LAYER = """{name}_rest AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY relevant DESC, place) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS p, bool_or(relevant) OVER (PARTITION BY conv_id) AS any_relevant FROM {name}_rows WHERE NOT must AND line <> ''),
{name} AS (SELECT conv_id, '{title}' || chr(10) || string_agg(line, chr(10) ORDER BY rank, place) AS content FROM (SELECT conv_id, 0 AS rank, place, line FROM {name}_rows WHERE must AND line <> '' UNION ALL SELECT conv_id, CASE WHEN any_relevant THEN r ELSE p END, place, line FROM {name}_rest WHERE (any_relevant AND relevant AND r <= {most}) OR (NOT any_relevant AND p <= {fallback})) GROUP BY 1)"""


@query("layered_prompt", f"""WITH q AS (SELECT conv_id, max(turn) AS last, regexp_extract(trim(arg_min(text, turn)), '^[^ ]+', 0) AS word FROM conversations GROUP BY 1),
turns_rows AS (SELECT conv_id, turn = last AS must, contains(text, word) AS relevant, turn AS place, role || ': ' || left(text, 200) AS line FROM conversations JOIN q USING (conv_id)),
notes_rows AS (SELECT conv_id, FALSE AS must, contains(line, word) AS relevant, i AS place, left(line, 120) AS line FROM q JOIN (SELECT doc_id AS conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) USING (conv_id)),
{_LAYER.format(name="turns", title="[turns]", most=4, fallback=2)}, {_LAYER.format(name="notes", title="[notes]", most=5, fallback=2)},
b AS (SELECT conv_id, t.content AS t, n.content AS n, least(length(t.content), 700) AS tn FROM turns t FULL JOIN notes n USING (conv_id)),
c AS (SELECT *, CASE WHEN length(n) <= 700 - coalesce(tn, 0) THEN length(n) WHEN 700 - coalesce(tn, 0) >= 100 THEN 700 - coalesce(tn, 0) ELSE 0 END AS nn FROM b)
SELECT conv_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN nn > 0 THEN left(n, nn) END, CASE WHEN tn > 0 THEN left(t, tn) END)) AS digest, CASE WHEN n IS NULL THEN NULL WHEN nn = length(n) THEN 'kept' WHEN nn > 0 THEN 'cut' ELSE 'dropped' END AS notes FROM c""")
def layered_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation its last turn, the turns and the lines of the document of its number that have its first word,
    in 700 characters, the turns first."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.regexp_extract(F.trim(F.min_by("text", "turn")), "^[^ ]+", 0).alias("word"))
    own = turns.join(asked, "conv_id").select("conv_id", (F.col("turn") == F.col("last")).alias("must"), F.contains("text", "word").cast("int").alias("relevance"), F.col("turn").alias("place"), F.concat("role", F.lit(": "), F.substring("text", 1, 200)).alias("line"))
    lines = cleaning.lines(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "conv_id").join(asked, "conv_id", "left_semi"), "conv_id", "text").join(asked, "conv_id")
    notes = lines.select("conv_id", F.lit(False).alias("must"), F.contains("line", "word").cast("int").alias("relevance"), F.col("line_no").cast("long").alias("place"), F.substring("line", 1, 120).alias("line"))
    both = [layers.Layer("turns", "[turns]", own, 90, 20, 4, 2), layers.Layer("notes", "[notes]", notes, 50, 10, 5, 2)]
    return layers.prompt(both, "conv_id", 700).select("conv_id", F.md5("prompt").alias("digest"), F.element_at("decisions", "notes").alias("notes"))
