"""Records kept in step: revisions, chunk tables, numbering, name resolution, thresholds, hits, sampling, hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.catalog.tables import USAGE_LOG, read, usage_log
from weft.functions import predicates
from weft.operators import aggregates, intervals, joins, retrieval, upsert, windows
from weft.plans import search
from weft.registry import query
from weft.streaming import events


@query("trailing_usage", f"SELECT event_id, (sum(total) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW))::BIGINT AS used FROM {USAGE_LOG}")
def trailing_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing(usage_log(spark, sf_dir), ["user_id"], "ts", 6 * 3600, "total", "used").select("event_id", "used")


@query("systematic_sample", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, greatest(count(*) OVER (PARTITION BY o_custkey) // 4, 1) AS step FROM orders) WHERE i % step = 0 AND i < step * 4")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.every_nth(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


@query("character_pool", """SELECT c_custkey, CASE WHEN s = 'alive' AND seen < 2370 THEN 'dormant' ELSE s END AS state, coalesce(s = 'alive' AND seen < 2370, FALSE) AS note FROM (
SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'departed' ELSE 'alive' END AS s, (SELECT max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) FROM orders WHERE o_custkey = c_custkey) AS seen FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def character_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    seen = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(day).alias("seen"))
    status = F.when(F.col("c_mktsegment") == "FURNITURE", "departed").when(F.col("c_mktsegment") == "BUILDING", "dead").otherwise("?")
    state = predicates.state_of(status, F.col("seen"), F.lit(2400), ["departed", "dead"], 30)
    rows = read(spark, sf_dir, "customer").join(seen, "c_custkey", "left").select("c_custkey", state.alias("state"))
    return rows.where("state <> 'dead'").withColumn("note", F.col("state") == "dormant")


@query("route_order", "SELECT p_name, n, rank FROM (SELECT p_name, n, row_number() OVER (ORDER BY n DESC, length(p_name) DESC, first) AS rank FROM (SELECT p_name, count(DISTINCT p_brand) AS n, min(p_partkey) AS first FROM part GROUP BY 1)) WHERE rank <= 20")
def route_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = read(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n"), F.min("p_partkey").alias("first"))
    best = routes.orderBy(F.col("n").desc(), F.length("p_name").desc(), "first").limit(20)  # a top-k report
    return retrieval.ranked(best, [], [F.col("n").desc(), F.length("p_name").desc(), F.col("first")]).select("p_name", "n", "rank")


_TERMS = ["the", "und", "que", "tion", "(", "lle"]
_TERM_ROWS = "(SELECT lang, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM documents, (VALUES ('the'), ('und'), ('que'), ('tion'), ('('), ('lle')) t(term))"


@query("term_hits", f"SELECT lang, term, count(*) AS in_rows, sum(n)::BIGINT AS hits FROM {_TERM_ROWS} WHERE n > 0 GROUP BY 1, 2")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.term_hits(read(spark, sf_dir, "documents"), "text", _TERMS, "lang")


@query("terms_together", "SELECT lang, a.term AS a, b.term AS b, count(*) AS in_rows FROM documents, (VALUES ('the'), ('und'), ('que'), ('tion'), ('('), ('lle')) a(term), (VALUES ('the'), ('und'), ('que'), ('tion'), ('('), ('lle')) b(term) WHERE a.term < b.term AND contains(text, a.term) AND contains(text, b.term) GROUP BY 1, 2, 3")
def terms_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.together(read(spark, sf_dir, "documents"), "text", _TERMS, "lang")


@query("core_symbols", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1)) WHERE r <= 2")
def core_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.core_symbols(read(spark, sf_dir, "events"), ["user_id"], "event_type", 2)


@query("proposed_changes", """SELECT s_suppkey AS key, coalesce(n, c_name) AS name, coalesce(k, c_nationkey)::INT AS nation, list_filter([CASE WHEN n IS DISTINCT FROM c_name AND n IS NOT NULL THEN 'name' END, CASE WHEN k IS DISTINCT FROM c_nationkey AND k IS NOT NULL THEN 'nation' END], lambda x: x IS NOT NULL) AS changed
FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS n, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END AS k FROM supplier) JOIN customer ON c_custkey = s_suppkey WHERE (n IS NOT NULL AND n IS DISTINCT FROM c_name) OR (k IS NOT NULL AND k IS DISTINCT FROM c_nationkey)""")
def proposed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    wanted = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey")).alias("nation"), "s_acctbal")
    return upsert.proposed(current, wanted, "key", ["name", "nation"])


_REVISIONS = "(SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS no, o_orderstatus, o_totalprice FROM orders)"


@query("revision_rollback", f"SELECT o_custkey, m + 1 AS no, no AS restored_from, o_orderstatus, o_totalprice FROM (SELECT *, max(no) OVER (PARTITION BY o_custkey) AS m FROM {_REVISIONS}) WHERE no = m - 2")
def revision_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    revisions = retrieval.ranked(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "no")
    return upsert.restored(revisions, "o_custkey", "no", 2, ["o_orderstatus", "o_totalprice"])


@query("next_number", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.next_number(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey")


@query("chunk_sync", """WITH chunks AS (SELECT doc_id, i, md5(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id % 4 < 3))
SELECT doc_id, i::INT AS i, line FROM chunks WHERE doc_id % 7 > 0 AND doc_id % 5 > 0 UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 > 0""")
def chunk_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of chunks brought up to date: three of four documents are in it, every fifth document is new or changed, and
    every seventh is gone. The table has one state only, so ids stand for these three groups."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = docs.where("doc_id % 4 < 3").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.md5("line"))
    new = docs.where("doc_id % 5 = 0").select("doc_id", F.lit(0).alias("i"), F.md5("text").alias("line"))
    return upsert.replaced(chunks, new, docs.where("doc_id % 7 > 0"), "doc_id")


@query("name_resolution", """WITH known AS (SELECT 'nation' AS kind, n_name AS name, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 'supplier', s_name, s_suppkey FROM supplier UNION ALL SELECT 'customer', c_name, c_custkey FROM customer),
asked AS (SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT 'The ' || n_name FROM nation UNION ALL SELECT 'X' || s_suppkey FROM supplier))
SELECT name, kind, id, TRUE AS exact FROM asked JOIN known USING (name) UNION ALL SELECT a.name, k.kind, k.id, FALSE FROM asked a JOIN known k ON right(a.name, 3) = right(k.name, 3) WHERE length(a.name) >= 5 AND length(k.name) >= 5 AND a.name NOT IN (SELECT name FROM known)""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name, prefix, key: read(spark, sf_dir, name).select(F.col(f"{prefix}_name").alias("name"), F.col(key).cast("long").alias("id"))
    tables = {"nation": table("nation", "n", "n_nationkey"), "supplier": table("supplier", "s", "s_suppkey"), "customer": table("customer", "c", "c_custkey")}
    nations = tables["nation"].select("name")
    asked = nations.union(nations.select(F.concat(F.lit("The "), "name"))).union(tables["supplier"].select(F.concat(F.lit("X"), "id")))
    return joins.resolved(asked, tables)


@query("existing_or_new", """SELECT l_orderkey, l_linenumber, coalesce(a, b) AS found, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 END::INT AS way FROM (SELECT * FROM lineitem WHERE l_linenumber = 2)
LEFT JOIN (SELECT l_suppkey, l_partkey, min(l_orderkey) AS a FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2) USING (l_suppkey, l_partkey) LEFT JOIN (SELECT l_partkey, l_shipdate, min(l_orderkey) AS b FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2) USING (l_partkey, l_shipdate)""")
def existing_or_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    found = joins.first_of(lines.where("l_linenumber = 2"), lines.where("l_linenumber = 1"), "l_orderkey", [["l_suppkey", "l_partkey"], ["l_partkey", "l_shipdate"]])
    return found.select("l_orderkey", "l_linenumber", "found", "way")


_CUTS = "(SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'purchase')"


@query("cut_clusters", f"SELECT user_id, list_sort(list(d))[len(list(d)) // 2 + 1] AS cut FROM (SELECT user_id, d, sum(new) OVER (PARTITION BY user_id ORDER BY d) AS run FROM (SELECT user_id, d, CASE WHEN d - lag(d) OVER (PARTITION BY user_id ORDER BY d) <= 2 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT user_id, d FROM {_CUTS}))) GROUP BY user_id, run")
def cut_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.cut_clusters(_cuts(spark, sf_dir), "user_id", "d", 2)


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", day.alias("d"))


@query("stitched_arcs")
def stitched_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _cuts(spark, sf_dir)
    spans = cuts.groupBy("user_id").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    arcs = intervals.stitched(cuts, spans, "user_id", "d", 2, 8)
    return intervals.arc_report(arcs, "user_id", 8, 40).join(spans, "user_id")


_ANCHOR = "(SELECT label AS slot, arg_min(embedding, vec_id) AS anchor, min(vec_id) AS anchor_id FROM embeddings GROUP BY 1)"
_SCORES = f"(SELECT slot, vec_id, label = slot AS positive, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 6) AS score FROM embeddings, {_ANCHOR} WHERE vec_id <> anchor_id)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first one of every label, a stated set of queries."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    anchors = rows.groupBy(F.col("label").alias("query_id")).agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("anchor"))
    found = retrieval.scored(anchors, rows, ["vec_id", "label"]).join(anchors.select("query_id", "anchor"), "query_id").where("vec_id <> anchor")
    return found.select(F.col("query_id").alias("slot"), "vec_id", (F.col("label") == F.col("query_id")).alias("positive"), "score")


_PLAIN = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _grounded_sql(evidence: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex({evidence}, '\\.{{3,}}|…+'), lambda x: {_PLAIN.format('x')}), lambda x: length(x) >= 4)"
    return f"len({parts}) > 0 AND len(list_filter({parts}, lambda x: NOT contains(p, x))) = 0"


@query("evidence_grounded", f"SELECT conv_id, turn, {_grounded_sql('text')} AS whole, {_grounded_sql("left(text, 20) || ' ... ' || right(text, 10)")} AS excerpt, {_grounded_sql("left(text, 20) || '… qqzzqqzz'")} AS foreign_text FROM (SELECT conv_id, turn, text, {_PLAIN.format('text')} AS p FROM conversations)")
def evidence_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    excerpt = F.concat(F.substring("text", 1, 20), F.lit(" ... "), F.right("text", F.lit(10)))
    foreign = F.concat(F.substring("text", 1, 20), F.lit("… qqzzqqzz"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", predicates.grounded(t, t).alias("whole"), predicates.grounded(excerpt, t).alias("excerpt"), predicates.grounded(foreign, t).alias("foreign_text"))


@query("text_gates", """SELECT conv_id, turn, length(t) >= 15 AND NOT contains(t, 'the') AND t NOT LIKE '{%' AND t NOT LIKE '[%' AS summary, length(left(t, 3)) < 2 OR contains(left(t, 3), 'Th') AS placeholder, contains(t, 'what ') OR t LIKE 'How%' OR (regexp_matches(t, '[?？]$') AND length(t) <= 60) AS question FROM (SELECT *, trim(text) AS t FROM conversations)""")
def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    gates = {"summary": predicates.summary_like(t, 15, "the"), "placeholder": predicates.placeholder(F.substring(F.trim(t), 1, 3), ["Th"]), "question": predicates.question(t, ["what "], ["How"])}
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *(c.alias(n) for n, c in gates.items()))


@query("majority_verdicts", "SELECT user_id, count(*) AS votes, count(*) FILTER (WHERE value > 0) AS up, CASE WHEN count(*) >= 2 AND count(*) FILTER (WHERE value > 100) * 2 > count(*) THEN 'up' WHEN count(*) >= 2 AND count(*) FILTER (WHERE value <= 100) * 2 > count(*) THEN 'down' ELSE 'keep' END AS verdict FROM events GROUP BY 1")
def majority_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("votes"), F.count(F.when(F.col("value") > 0, 1)).alias("up"), F.count(F.when(F.col("value") > 100, 1)).alias("__up"), F.count(F.when(F.col("value") <= 100, 1)).alias("__down"))
    several = F.col("votes") >= 2
    verdict = F.when(several & (F.col("__up") * 2 > F.col("votes")), "up").when(several & (F.col("__down") * 2 > F.col("votes")), "down").otherwise("keep")
    return by.select("user_id", "votes", "up", verdict.alias("verdict"))


@query("nested_arcs", """SELECT user_id, string_agg(day || ':' || label || ':' || n, ';' ORDER BY day) AS segments, sum(n)::BIGINT AS n FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS l, count(*) AS n FROM events GROUP BY 1, 2) t, LATERAL (SELECT coalesce(l, '-') AS label) GROUP BY 1""")
def nested_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.when(F.col("event_type") != "error", F.struct("ts", "event_id", "event_type"))  # the last that is not null
    days = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max(valid).alias("last"), F.count("*").alias("n"))
    part = F.concat_ws(":", "day", F.coalesce("last.event_type", F.lit("-")), "n")
    by = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", part.alias("part")))).alias("parts"), F.sum("n").alias("n"))
    return by.select("user_id", F.array_join(F.transform("parts", lambda x: x["part"]), ";").alias("segments"), "n")


@query("calibrated_slots", f"""SELECT slot, round(pos_min, 6) AS pos_min, round(neg_max, 6) AS neg_max, round(best, 6) AS best, round(CASE WHEN pos_min > neg_max THEN (pos_min + neg_max) / 2 ELSE pos_min * 0.9 END, 8) AS threshold
FROM (SELECT slot, min(score) FILTER (WHERE positive) AS pos_min, max(score) FILTER (WHERE NOT positive) AS neg_max FROM {_SCORES} GROUP BY 1) JOIN (SELECT slot, avg(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC) AS r FROM {_SCORES}) WHERE r <= 3 GROUP BY 1) USING (slot)""")
def calibrated_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.calibrated(_scores(spark, sf_dir), "slot", F.col("positive"), "score")
    return found.select("slot", *(F.round(c, 8 if c == "threshold" else 6).alias(c) for c in ("pos_min", "neg_max", "best", "threshold")))


@query("slot_assignment")
def slot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an order's pairs are made of its lines in one row: no join, and only lines are shuffled
    line = F.struct(F.col("l_linenumber").alias("slot"), F.col("l_suppkey").alias("candidate"), F.col("l_quantity").alias("n"))
    orders = read(spark, sf_dir, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    pair = lambda a, b: F.struct((-F.abs(a["n"] - b["n"] - b["candidate"] % 7)).alias("score"), a["slot"].alias("slot"), b["candidate"].alias("candidate"))
    pairs = F.flatten(F.transform("lines", lambda a: F.transform("lines", lambda b: pair(a, b))))
    return retrieval.picked(orders.select("l_orderkey", pairs.alias("__pairs")), "l_orderkey", "slot", "candidate", "score")


_ROWS = "(SELECT vec_id, label, embedding, text, source, regexp_extract(trim(text), '^[^ ]+', 0) AS word FROM embeddings JOIN documents ON doc_id = vec_id)"
_NEAR = f"(SELECT query_id, row_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS r, max(s) OVER (PARTITION BY query_id) AS t FROM (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS s FROM {_ROWS} q JOIN {_ROWS} r ON q.label = r.label WHERE q.vec_id % 50 = 0)) WHERE r <= 20 AND s >= t * 0.3)"
_WORDS = f"(SELECT query_id, row_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, row_id) AS r FROM (SELECT q.vec_id AS query_id, r.vec_id AS row_id, len(string_split(lower(r.text), lower(q.word))) - 1 AS h FROM {_ROWS} q JOIN {_ROWS} r ON q.label = r.label WHERE q.vec_id % 50 = 0 AND q.word <> '') WHERE h > 0) WHERE r <= 20)"
_FUSED = f"(SELECT query_id, row_id, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM {_NEAR} UNION ALL SELECT * FROM {_WORDS}) GROUP BY 1, 2)"
_NEWEST = f"(SELECT vec_id AS row_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS new FROM {_ROWS})"


@query("hybrid_search", f"""WITH found AS (SELECT f.query_id, f.row_id, f.score, CASE WHEN q.source = r.source THEN 0 ELSE 1 END AS tier, 0 AS new FROM {_FUSED} f JOIN {_ROWS} q ON q.vec_id = query_id JOIN {_ROWS} r ON r.vec_id = row_id)
SELECT query_id, row_id, round(score, 12) AS score, tier::INT AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, new, row_id) AS rank FROM (SELECT * FROM found UNION ALL SELECT q.vec_id, n.row_id, 0, 2, n.new FROM {_ROWS} q JOIN {_NEWEST} n ON q.label = n.label WHERE q.vec_id % 50 = 0 AND n.new <= 20 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = q.vec_id AND f.row_id = n.row_id))) WHERE rank <= 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "source")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("vector"), F.col("vec_id").alias("made")).join(docs, "row_id")
    word = F.regexp_extract(F.trim("text"), "^[^ ]+", 0)
    queries = rows.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "label", "vector", word.alias("word"), "source")
    found = search.hybrid(queries, rows, "label", exact=F.col("source") == F.col("q_source"))
    return found.withColumn("score", F.round("score", 12))


@query("tagged_parts", "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['widget', 'ring'])")
def tagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.tagged(read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tags")), F.col("tags"), ["Widget", "RING", " "]).select("p_partkey")


@query("settled_arcs", f"SELECT user_id, lo, hi FROM (SELECT user_id, d AS lo, lead(d) OVER (PARTITION BY user_id ORDER BY d) - 1 AS hi FROM (SELECT DISTINCT user_id, d FROM {_CUTS})) WHERE hi <= 30 - 5")
def settled_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _cuts(spark, sf_dir).withColumn("last", F.lit(None).cast("long"))
    return events.settled(intervals.from_cuts(cuts, "user_id", "d", "last"), F.lit(30), 5)


@query("quarter_counts", "SELECT o_custkey, least(floor((i - 1) * 4 / n) + 1, 4)::INT AS quarter, count(*) AS orders FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY 1, 2")
def quarter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    ranked = retrieval.ranked(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "i")
    placed = ranked.join(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")
    return placed.groupBy("o_custkey", windows.quarters(F.col("i") - 1, F.col("n")).alias("quarter")).agg(F.count("*").alias("orders"))


@query("merged_turns", "SELECT conv_id, turn, sum(CASE WHEN s >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS merged FROM (SELECT conv_id, turn, CASE WHEN p IS NOT NULL THEN least(n, p) / greatest(n, p, 1) END AS s FROM (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE text IS NOT NULL))")
def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.length("text").alias("n"))
    both = turns.withColumn("p", F.lag("n").over(Window.partitionBy("conv_id").orderBy("turn")))
    alike = F.when(F.col("p").isNotNull(), F.least("n", "p") / F.greatest("n", "p", F.lit(1)))
    return intervals.merged_neighbours(both.withColumn("alike", alike), "conv_id", "turn", F.col("alike"), 0.5).select("conv_id", "turn", "merged")
