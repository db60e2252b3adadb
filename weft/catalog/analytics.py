"""Usage, evaluation, feedback, presence and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog.tables import BUCKET, USAGE_LOG, read, usage_log
from weft.functions import predicates, text, vector
from weft.operators import aggregates, joins, upsert, windows
from weft.registry import query


@query("usage_summary", f"SELECT CASE WHEN GROUPING(scene) = 0 THEN 'scene' WHEN GROUPING(day) = 0 THEN 'day' ELSE 'overall' END AS level, coalesce(scene, day, 'all') AS name, {BUCKET} FROM {USAGE_LOG} GROUP BY GROUPING SETS ((), (scene), (day))")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.usage_sets(usage_log(spark, sf_dir), ["scene", "day"])


@query("usage_by_scene", f"SELECT coalesce(scene, '(none)') AS scene, {BUCKET} FROM {USAGE_LOG} GROUP BY 1")
def usage_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.usage(usage_log(spark, sf_dir), "scene")


@query("usage_by_user_day", f"SELECT coalesce(CAST(user_id AS VARCHAR), '(none)') AS user_id, coalesce(day, '(none)') AS day, {BUCKET} FROM {USAGE_LOG} GROUP BY 1, 2")
def usage_by_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.usage(usage_log(spark, sf_dir), "user_id", "day")


@query("usage_last_days", f"SELECT day, {BUCKET} FROM {USAGE_LOG} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def usage_last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = usage_log(spark, sf_dir)
    last = log.agg(F.max("ts").cast("string")).first()[0]  # one value, so that the scan can be pruned by it
    return aggregates.usage(log.where(F.col("ts") >= F.lit(last).cast(dict(log.dtypes)["ts"]) - F.expr("INTERVAL 7 DAY")), "day")


@query("usage_recent", f"SELECT event_id, scene, total FROM {USAGE_LOG} ORDER BY ts DESC, event_id DESC LIMIT 50")
def usage_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_log(spark, sf_dir).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "scene", "total")


@query("latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.latest(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("score_summary", "SELECT source, count(*) AS n_rows, count(quality) AS n_scored, round(avg(quality), 2) AS mean_score, arg_min(doc_id, (-quality, doc_id)) FILTER (WHERE quality IS NOT NULL) AS best FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.score_summary(rows, "source", "quality", "doc_id")


@query("feedback_stats", "SELECT lang, count(*) AS n, avg(coalesce(CAST(quality AS DOUBLE), 1.0)) AS mean_similarity, 1 - avg(coalesce(CAST(quality AS DOUBLE), 1.0)) AS change_ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.feedback_stats(rows.withColumn("s", F.col("quality").cast("double")), "lang", "s")


@query("rollup_region", "SELECT r_name, n_name, c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spent, CAST(GROUPING(r_name) + GROUPING(n_name) + GROUPING(c_mktsegment) AS INT) AS depth FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def rollup_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    # orders are summed for each customer before the dimensions are joined, so only customers are rolled up
    by_customer = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    rows = customer.join(by_customer, customer.c_custkey == by_customer.o_custkey, "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.sum("s").cast("double").alias("spent"), (F.grouping("r_name") + F.grouping("n_name") + F.grouping("c_mktsegment")).cast("int").alias("depth"))
    return out


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("at"))


DAYS = "(SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no FROM events)"


def _islands(gap: int) -> str:
    return f"SELECT user_id, CAST(run AS BIGINT) AS run, min(day_no) AS first, max(day_no) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day_no) AS run FROM (SELECT *, CASE WHEN day_no - lag(day_no) OVER (PARTITION BY user_id ORDER BY day_no) <= {gap} THEN 0 ELSE 1 END AS new FROM {DAYS})) GROUP BY user_id, run"


@query("presence_runs", _islands(1).replace("min(day_no)", "min(day_no)::INT").replace("max(day_no)", "max(day_no)::INT"))
def presence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.runs(_days(spark, sf_dir), ["user_id"], "at", 1)


@query("presence_stitch", _islands(3).replace("min(day_no)", "min(day_no)::INT").replace("max(day_no)", "max(day_no)::INT"))
def presence_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.runs(_days(spark, sf_dir), ["user_id"], "at", 3)


@query("presence_grade", f"""WITH seg AS ({_islands(1)}), c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY first) AS cluster FROM (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY user_id ORDER BY first) > 2 OR lag(last) OVER (PARTITION BY user_id ORDER BY first) IS NULL THEN 1 ELSE 0 END AS new FROM seg)),
g AS (SELECT user_id, sum(n) AS total, count(*) FILTER (WHERE n >= 4) AS segments, max(cluster) AS clusters FROM c GROUP BY user_id)
SELECT user_id, total::BIGINT AS total, segments, clusters::BIGINT AS clusters, CASE WHEN total < 5 THEN 0 WHEN total < 10 THEN 1 WHEN total >= 25 AND total >= 30 * 0.4 AND clusters >= 1 THEN 5 WHEN total >= 20 AND segments >= 2 THEN 4 WHEN total >= 20 OR segments >= 1 THEN 3 ELSE 2 END::INT AS grade FROM g""")
def presence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = windows.runs(_days(spark, sf_dir), ["user_id"], "at", 1)
    by = windows.clusters(segments, ["user_id"], 2).groupBy("user_id").agg(F.count("*").alias("clusters"))
    g = segments.groupBy("user_id").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= 4).alias("segments")).join(by, "user_id")
    return g.select("user_id", "total", "segments", "clusters", windows.presence_grade(F.col("total"), F.lit(30), F.col("segments"), F.col("clusters"), (5, 10, 20, 25)).alias("grade"))


@query("run_lengths", "SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, run")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_lengths(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("dispatch_rank", "SELECT p_partkey, p_type, r = 1 OR p_type = 'PROMO' AS active, CASE WHEN r > 1 AND NOT p_type = 'PROMO' THEN w END AS winner FROM (SELECT *, row_number() OVER o AS r, first_value(p_partkey) OVER o AS w FROM part WINDOW o AS (PARTITION BY p_type ORDER BY p_size DESC, p_partkey))")
def dispatch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return windows.dispatch(part, "p_type", "p_size", "p_partkey", ~(F.col("p_type") == "PROMO")).select("p_partkey", "p_type", "active", "winner")


@query("thread_recent", "SELECT conv_id, turn, role, CASE WHEN length(text) > 400 THEN left(text, 400) || '…' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 8")
def thread_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top(read(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn").desc()], 8).select("conv_id", "turn", "role", text.clipped(F.col("text"), 400).alias("text"))


@query("thread_archive", "SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS note, count(*) AS turns FROM conversations GROUP BY conv_id")
def thread_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("note"), F.count("*").alias("turns"))


@query("previous_order", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_custkey")
def previous_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")).select("o_custkey", "o_orderdate", "o_orderkey")
    return aggregates.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("change_log", "SELECT o_custkey, o_orderkey, CAST(o_orderstatus IS DISTINCT FROM ps AS INT) + CAST(o_orderpriority IS DISTINCT FROM pp AS INT) AS n_changed FROM (SELECT *, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE o_orderstatus IS DISTINCT FROM ps OR o_orderpriority IS DISTINCT FROM pp")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return windows.changes(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_custkey", "o_orderkey", F.size("changed").alias("n_changed"))


@query("uncompressed_range", "WITH c AS (SELECT user_id, max(day_no) AS last FROM (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no FROM events WHERE event_type = 'purchase') WHERE day_no < 10 GROUP BY user_id) SELECT user_id, min(day_no)::INT AS first, max(day_no)::INT AS last FROM (SELECT d.user_id, d.day_no, row_number() OVER (PARTITION BY d.user_id ORDER BY d.day_no) AS r FROM (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no FROM events) d LEFT JOIN c USING (user_id) WHERE d.day_no > coalesce(c.last, 0)) WHERE r <= 10 GROUP BY user_id HAVING count(*) = 10")
def uncompressed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).distinct()
    bought = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("last")).where("last < 10")
    return windows.first_uncovered(days, bought, "user_id", "at", 10)


@query("carryover_diff", "SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 3 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 3)")
def carryover_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    last = events.agg(F.max(F.to_date("ts")).cast("string")).first()[0]
    recent = events.where(F.col("ts") >= F.date_sub(F.lit(last).cast("date"), 2).cast(dict(events.dtypes)["ts"])).select("user_id", "event_type").distinct()
    return joins.absent(recent, recent.where("event_type = 'purchase'"), ["user_id"]).select("user_id").distinct()


@query("cooccur_pairs", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def cooccur_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.pair_counts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("appearances", "SELECT c_custkey, coalesce(n, 0) AS n, last_seen FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_seen FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_seen"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("size_histogram", "SELECT source, CASE WHEN length(text) < 1000 THEN '<1k' WHEN length(text) < 3000 THEN '1~3k' WHEN length(text) < 5000 THEN '3~5k' WHEN length(text) < 10000 THEN '5~10k' ELSE '>=10k' END AS bucket, count(*) AS n FROM documents GROUP BY 1, 2")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = aggregates.size_buckets(F.length("text"), [(1000, "<1k"), (3000, "1~3k"), (5000, "3~5k"), (10_000, "5~10k")], ">=10k")
    return read(spark, sf_dir, "documents").groupBy("source", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("size_percentiles", "SELECT lang, count(n_chars) AS n, min(n_chars) AS least, max(n_chars) AS most, quantile_disc(n_chars, 0.1) AS p10, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90 FROM documents GROUP BY lang")
def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.index_percentiles(read(spark, sf_dir, "documents"), "lang", "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("majority_tags", "SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) JOIN (SELECT c_nationkey, count(DISTINCT c_custkey) AS members FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) USING (c_nationkey) WHERE n * 5 >= members")
def majority_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"))
    return aggregates.majority_tags(rows, "c_nationkey", "c_custkey", "c_mktsegment", 5)


@query("median_profile", "SELECT label, m AS median, (SELECT a FROM (VALUES (0), (1), (-1), (4), (-4), (7), (-7), (10), (-10)) v(a) ORDER BY abs(m - a), abs(a), a LIMIT 1)::INT AS anchor, spread FROM (SELECT label, quantile_disc(round(CAST(embedding[1] AS DOUBLE) * 40, 3), 0.5) AS m, round(max(round(CAST(embedding[1] AS DOUBLE) * 40, 3)) - min(round(CAST(embedding[1] AS DOUBLE) * 40, 3)), 3) AS spread FROM embeddings GROUP BY label)")
def median_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.round(F.element_at("embedding", 1).cast("double") * 40, 3).alias("x"))
    by = aggregates.index_percentiles(rows, "label", "x", {"median": 0.5}).withColumn("spread", F.round(F.col("most") - F.col("least"), 3))
    return by.select("label", "median", aggregates.snap(F.col("median"), [0, 1, -1, 4, -4, 7, -7, 10, -10]).alias("anchor"), "spread")


@query("interval_best_overlap", """SELECT id, arg_min(rid, (-o, rid)) AS rid, max(o) AS overlap FROM (SELECT a.o_orderkey AS id, b.o_orderkey AS rid, least(a.d + 20, b.d + 30) - greatest(a.d, b.d) + 1 AS o
FROM (SELECT *, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderpriority LIKE '1%') a JOIN (SELECT *, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderpriority NOT LIKE '1%') b ON a.o_custkey = b.o_custkey AND a.d <= b.d + 30 AND b.d <= a.d + 20) GROUP BY id""")
def interval_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    orders = read(spark, sf_dir, "orders").withColumn("d", day)
    left = orders.where("o_orderpriority like '1%'").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("d").alias("lo"), (F.col("d") + 20).alias("hi"))
    right = orders.where("o_orderpriority not like '1%'").select("o_custkey", F.col("o_orderkey").alias("rid"), F.col("d").alias("rlo"), (F.col("d") + 30).alias("rhi"))
    return joins.best_overlap(left, right, "o_custkey", 64)


@query("as_of_status", "SELECT e.event_id, o.o_orderkey AS last_order FROM (SELECT *, user_id AS k FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT o_custkey AS k, o_orderkey, o_orderdate + INTERVAL 10000 DAY AS at FROM (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)) o ON e.k = o.k AND e.ts >= o.at")
def as_of_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("k"), "ts")
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 10000 DAY")).alias("ts")).agg(F.max("o_orderkey").alias("last_order"))
    return upsert.as_of(events, orders, "k", "ts", "last_order").select("event_id", "last_order")


@query("lookup_in_order", "SELECT id, coalesce(c_name, s_name) AS name, CASE WHEN c_name IS NOT NULL THEN 0 ELSE 1 END::INT AS found_in FROM (SELECT DISTINCT l_suppkey * 20 AS id FROM lineitem UNION SELECT s_suppkey FROM supplier) LEFT JOIN customer ON c_custkey = id LEFT JOIN supplier ON s_suppkey = id WHERE c_name IS NOT NULL OR s_name IS NOT NULL")
def lookup_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    ids = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 20).alias("id")).union(suppliers.select("id")).distinct()
    return joins.lookup(ids, "id", [read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), suppliers], ["name"])


@query("loose_conditions", "SELECT event_type, count(*) AS n FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND (event_type LIKE 'p%' OR event_type LIKE '%k') GROUP BY event_type")
def loose_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    rule = predicates.all_or_any([predicates.compare("ge", k, F.lit("50")), predicates.all_or_any([predicates.compare("start_with", kind, F.lit("p")), predicates.compare("end_with", kind, F.lit("k"))], "or")])
    return read(spark, sf_dir, "events").where(rule & predicates.compare("not_empty", k, F.lit(""))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("geo_bearing", """SELECT id, other, round(d, 6) AS distance, CASE WHEN a < 45 THEN 'N' WHEN a < 90 THEN 'NE' WHEN a < 135 THEN 'E' WHEN a < 180 THEN 'SE' WHEN a < 225 THEN 'S' WHEN a < 270 THEN 'SW' WHEN a < 315 THEN 'W' ELSE 'NW' END AS bearing FROM (
SELECT *, (degrees(atan2(dx, dy)) + 22.5 + 360) - 360 * floor((degrees(atan2(dx, dy)) + 22.5 + 360) / 360) AS a, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM (SELECT p.vec_id AS id, q.vec_id AS other, q.embedding[1]::DOUBLE - p.embedding[1]::DOUBLE AS dx, q.embedding[2]::DOUBLE - p.embedding[2]::DOUBLE AS dy, sqrt(pow(q.embedding[1]::DOUBLE - p.embedding[1]::DOUBLE, 2) + pow(q.embedding[2]::DOUBLE - p.embedding[2]::DOUBLE, 2)) AS d FROM embeddings p JOIN embeddings q ON p.label = q.label AND p.vec_id <> q.vec_id AND p.vec_id % 50 = 0)) WHERE r <= 3""")
def geo_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    others = points.select("label", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = points.where("id % 50 = 0").join(others, "label").where("id <> other").withColumns({"dx": F.col("ox") - F.col("x"), "dy": F.col("oy") - F.col("y")})
    pairs = pairs.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return windows.top(pairs, ["id"], [F.col("d"), F.col("other")], 3).select("id", "other", F.round("d", 6).alias("distance"), vector.bearing(F.col("dx"), F.col("dy")).alias("bearing"))


@query("page_of_orders", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    page = orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(40).limit(20)
    return page.join(F.broadcast(orders.agg(F.count("*").alias("total")))).select("o_orderkey", "total")


@query("name_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%'")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_name ilike '%re%' or p_brand ilike '%re%'").select("p_partkey", "p_name")
