"""Restarted numbering, names to clean, probes of texts, reports of templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import corpus
from weft.catalog.notes import _ANCHOR, _DECIDED, _MARKER
from weft.catalog.tables import read
from weft.functions import text as T
from weft.operators import cleaning, intervals, sequences, style, templates, upsert, windows
from weft.plans import cleaning as plans
from weft.registry import query

_NUMBER = "TRY_CAST(nullif(regexp_extract(text, '(\\d{1,6})', 1), '') AS INT)"


@query("restarts", f"""WITH o AS (SELECT doc_id, source, doc_id - {_NUMBER} AS o FROM documents), u AS (SELECT source, arg_min(o, (-n, o)) AS usual FROM (SELECT source, o, count(*) AS n FROM o WHERE o IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, usual, coalesce(o - usual > 20, FALSE) AS restarted FROM o LEFT JOIN u USING (source)""")
def restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as chapters, whose numbers are the first ones in their texts."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", T.first_number(F.col("text")).alias("no"))
    return cleaning.restarts(rows, "source", "doc_id", "no", 20).select("doc_id", "usual", "restarted")


@query("renames", r"""WITH n AS (SELECT doc_id, left(text, 60) AS old FROM documents), w AS (SELECT *, trim(regexp_replace(regexp_replace(old, '[\x00-\x1F\x7F]', '', 'g'), '\s{2,}', ' ', 'g')) AS new FROM n WHERE regexp_matches(old, '[\x00-\x1F\x7F]')),
f AS (SELECT * FROM w WHERE new <> '' AND new <> old)
SELECT doc_id, old, new, CASE WHEN new IN (SELECT old FROM n WHERE old IS NOT NULL) OR doc_id <> min(doc_id) OVER (PARTITION BY new) THEN 'taken' ELSE 'rename' END AS state FROM f""")
def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by their first 60 characters, line ends and all."""
    return cleaning.renames(read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("name")), "doc_id", "name")


_PROBES = {"article": ["the ", "der ", "les "], "joining": [" und ", " and ", " et "], "rights": ["Copyright", "licensed under", "Licensed under"], "link": ["http://", "https://"]}
_PROBE_ROWS = ", ".join(f"('{b}', '{w}')" for b, ws in _PROBES.items() for w in ws)


@query("text_probes", f"""WITH h AS (SELECT doc_id, beat, count(*) AS words, sum((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS n, min((instr(text, word) - 1) * 100 // length(text))::INT AS first FROM documents JOIN (VALUES {_PROBE_ROWS}) p(beat, word) ON contains(text, word) GROUP BY 1, 2)
SELECT d.doc_id, length(text) AS chars, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '')) AS paragraphs, regexp_matches(rtrim(replace(text, chr(10), ' ')), '[.!?。！？]$') AS closed, contains(right(text, 60), '...') OR contains(right(text, 60), '…') AS hangs, coalesce(l, '') AS hits
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(beat || ':' || words || ':' || n || ':' || first, ';' ORDER BY beat) AS l FROM h GROUP BY 1) USING (doc_id) WHERE text IS NOT NULL""")
def text_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.createDataFrame([(b, w) for b, ws in _PROBES.items() for w in ws], "beat string, word string")
    found = style.probed(read(spark, sf_dir, "documents"), "doc_id", "text", probes, ["...", "…"])
    return found.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["beat"], h["words"], h["n"], h["first"])), ";"))


@query("template_report")
def template_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.rendered(corpus.skeleton_templates(spark, sf_dir), "user_id")


@query("sequence_diagnosis")
def sequence_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of each user's days, in weeks: how much their sequences have in common."""
    days = corpus._symbols(read(spark, sf_dir, "events").where("user_id is not null").withColumn("day", F.to_date("ts")), "user_id", "day")
    return sequences.diagnosed(days.withColumn("week", F.weekofyear("day")), "user_id", "a", "week")


_CHAPTERS = "(SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_totalprice FROM orders)"


@query("segmented_orders", f"""WITH p AS (SELECT o_custkey, i AS lo, i + CASE WHEN o_totalprice > 300000 THEN 3 ELSE 1 END AS hi FROM {_CHAPTERS} WHERE o_totalprice > 200000), c AS (SELECT c.o_custkey, i, min(lo) AS lo FROM {_CHAPTERS} c LEFT JOIN p ON p.o_custkey = c.o_custkey AND i BETWEEN lo AND hi GROUP BY 1, 2)
SELECT o_custkey, i, dense_rank() OVER (PARTITION BY o_custkey ORDER BY coalesce(lo, i)) AS segment FROM c""")
def segmented_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as chapters; a dear one proposes a segment of itself and the next one or three."""
    rows = windows.numbered(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "i")
    far = F.when(F.col("o_totalprice") > 300_000, 3).otherwise(1)
    proposals = rows.where("o_totalprice > 200000").select("o_custkey", F.col("i").alias("lo"), (F.col("i") + far).alias("hi"))
    return intervals.segmented(rows, proposals, "o_custkey", "i")


_ALLOWED = {"signup": ["view", "click"], "view": ["click", "purchase", "error"], "click": ["view", "purchase"], "purchase": ["view"], "error": ["signup"]}
_GOOD = " OR ".join(f"(split_part(a, '|', 1) = '{a}' AND t IN ({', '.join(repr(x) for x in b)}))" for a, b in _ALLOWED.items())


@query("state_transitions", f"""SELECT user_id, split_part(r, '|', 1) AS state, split_part(r, '|', 2)::INT AS applied, n - split_part(r, '|', 2)::INT AS rejected FROM (SELECT user_id, count(*)::INT AS n,
list_reduce(list_prepend('signup|0', list(event_type ORDER BY ts, event_id)), lambda a, t: CASE WHEN {_GOOD} THEN t || '|' || (split_part(a, '|', 2)::INT + 1) ELSE a END) AS r FROM events GROUP BY 1)""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as requests for the state that they name, of which only some may follow each other."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("to"))
    none = spark.createDataFrame([], f"user_id {dict(events.dtypes)['user_id']}, state string")
    return upsert.transitioned(none, events, "user_id", ["ts", "event_id"], _ALLOWED, "signup")


@query("profile_texts", "SELECT c_custkey, concat_ws('; ', 'name: ' || c_name, CASE WHEN c_acctbal > 0 THEN 'balance: ' || c_acctbal::BIGINT END, CASE WHEN n_name LIKE 'A%' THEN 'home: ' || n_name END, lower(c_mktsegment)) AS profile FROM customer JOIN nation ON n_nationkey = c_nationkey")
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    home = F.when(F.col("n_name").like("A%"), F.col("n_name")).otherwise(" ")
    parts = [("name", F.col("c_name")), ("balance", F.when(F.col("c_acctbal") > 0, F.rint("c_acctbal").cast("long"))), ("home", home), ("", F.lower("c_mktsegment"))]
    return rows.select("c_custkey", T.labelled(parts).alias("profile"))


_RESTARTED = f"""(WITH o AS (SELECT doc_id, source, doc_id - {_NUMBER} AS o FROM documents), u AS (SELECT source, arg_min(o, (-n, o)) AS usual FROM (SELECT source, o, count(*) AS n FROM o WHERE o IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, coalesce(o - usual > 100, FALSE) AS restarted FROM o LEFT JOIN u USING (source))"""
_LAST = r"""CASE WHEN l IS NULL THEN 'empty' WHEN regexp_matches(l, '(?i)(to be continued|stay tuned|see you|thanks for reading)') THEN 'author_talk' WHEN regexp_matches(trim(l), '[.!?…"''”’)\]]$') THEN 'clean' ELSE 'truncated' END"""
_PLAN = f"""(WITH d AS (SELECT f.doc_id, source, text, cut, tail, restarted, decision, regexp_matches(left(text, 60), '[\\x00-\\x1F\\x7F]') AND trim(regexp_replace(regexp_replace(left(text, 60), '[\\x00-\\x1F\\x7F]', '', 'g'), '\\s{{2,}}', ' ', 'g')) <> '' AS named FROM {_DECIDED} f JOIN documents USING (doc_id) JOIN {_RESTARTED} USING (doc_id)),
r AS (SELECT *, CASE WHEN restarted THEN 'restart' WHEN decision = 'whole' THEN 'foreign' WHEN decision = 'tail' THEN 'tail' WHEN named THEN 'name' ELSE 'none' END AS rule FROM d),
e AS (SELECT *, list_filter(string_split(CASE WHEN rule = 'tail' THEN array_to_string(string_split(text, chr(10))[:cut - 1], chr(10)) ELSE text END, chr(10)), lambda x: trim(x) <> '')[-1] AS l FROM r)
SELECT doc_id, source, CASE WHEN rule IN ('restart', 'foreign') THEN 'B' WHEN rule = 'tail' THEN 'A' WHEN rule = 'name' THEN 'R' ELSE 'none' END AS action, rule, CASE WHEN rule = 'tail' THEN cut END::INT AS cut, CASE WHEN rule = 'tail' THEN tail ELSE 0 END::BIGINT AS tail, CASE WHEN rule NOT IN ('restart', 'foreign') THEN {_LAST} END AS "end" FROM e)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chapters of their sources, named by their first 60 characters."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "text", F.substring("text", 1, 60).alias("name"))
    return plans.plan(rows, "doc_id", "source", "doc_id", "name", "text", T.first_number(F.col("text")), _ANCHOR, _MARKER)


@query("cleaning_plan", f"SELECT * FROM {_PLAN}")
def cleaning_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("doc_id", "source", "action", "rule", "cut", "tail", "end")


@query("plan_overview", f"""SELECT source, count(*) AS texts, count(*) FILTER (WHERE action = 'A') AS cut, count(*) FILTER (WHERE action = 'B') AS quarantined, count(*) FILTER (WHERE action = 'R') AS renamed, count(*) FILTER (WHERE "end" = 'truncated') AS truncated, sum(tail)::BIGINT AS characters FROM {_PLAN} GROUP BY 1""")
def plan_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.overview(_plan(spark, sf_dir), "source")


@query("defect_sets", f"""SELECT source, defect, list(DISTINCT doc_id ORDER BY doc_id) AS places FROM (SELECT source, doc_id, rule AS defect FROM {_PLAN} WHERE rule <> 'none' UNION ALL SELECT source, doc_id, 'truncated' FROM {_PLAN} WHERE "end" = 'truncated') GROUP BY 1, 2""")
def defect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.defects(_plan(spark, sf_dir), "source", "doc_id")
