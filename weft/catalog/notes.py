"""Commands, labels and lists in texts; injected blocks; pairings, aliases, ledgers and rebuilt edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.catalog.tables import read
from weft.functions import text as T
from weft.operators import cleaning, dictionary, graph, joins, retrieval, upsert
from weft.registry import query

_TURNS = r"(SELECT conv_id, turn, coalesce(text, '') || chr(10) || '[[load: ' || conv_id || ', ,' || turn || ' ]]' || chr(10) || 'end' AS t FROM conversations)"


@query("load_commands", rf"SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_extract(t, '\[\[load:([^\]]*)\]\]', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS ids, md5(regexp_replace(t, '(?m)^[ \t]*\[\[load:[^\]]*\]\][ \t]*\n?', '', 'g')) AS digest FROM {_TURNS}")
def load_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.coalesce("text", F.lit("")), F.lit("\n[[load: "), "conv_id", F.lit(", ,"), "turn", F.lit(" ]]\nend"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.load_ids(t).alias("ids"), F.md5(T.without_commands(t)).alias("digest"))


@query("ascii_scrubbed", "SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[A-Za-z]{2,}', '', 'g'), ' +', ' ', 'g'), ' ') AS t FROM documents)")
def ascii_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.without_ascii_words(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


@query("beat_labels", "SELECT p_partkey, p_name AS symbol, CASE WHEN p_size % 3 > 0 THEN p_size ELSE 1 END::INT AS times FROM part")
def beat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("p_size") % 3 > 0, F.concat("p_name", F.lit(" × "), "p_size")).otherwise(F.col("p_name"))
    symbol, times = T.beat(label)
    return read(spark, sf_dir, "part").select("p_partkey", symbol.alias("symbol"), times.alias("times"))


@query("listed_parts", "SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[;；\n]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations")
def listed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.as_list(F.col("text")).alias("parts"))


@query("script_counts", r"""SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS ideographs, len(regexp_extract_all(text, '\p{Latin}')) AS latin, len(regexp_extract_all(text, '[À-ÿ]')) AS accented, len(regexp_extract_all(text, '\p{Cyrillic}')) AS cyrillic, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[#*$%&|]{4,}'))) AS ruled_lines FROM documents""")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each script, and lines that begin with a rule of symbols, of whole documents."""
    t, n = F.col("text"), lambda p: F.regexp_count("text", F.lit(p))
    ruled = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"^\s*[#*$%&|]{4,}")))
    return read(spark, sf_dir, "documents").select("doc_id", T.ideographs(t).alias("ideographs"), n(r"\p{IsLatin}").alias("latin"), n("[À-ÿ]").alias("accented"), n(r"\p{IsCyrillic}").alias("cyrillic"), ruled.alias("ruled_lines"))


@query("number_offsets", "SELECT CASE WHEN d > 30 THEN 31 WHEN d < -30 THEN -31 ELSE d END::INT AS shift, count(*) AS n FROM (SELECT TRY_CAST(nullif(regexp_extract(text, '(\\d{1,6})', 1), '') AS INT) - doc_id % 100 AS d FROM documents) WHERE d IS NOT NULL GROUP BY 1")
def number_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.first_number(F.col("text")) - F.col("doc_id") % 100
    return read(spark, sf_dir, "documents").select(F.when(d > 30, 31).when(d < -30, -31).otherwise(d).cast("int").alias("shift")).where("shift is not null").groupBy("shift").agg(F.count("*").alias("n"))


_WORDS = ["und", "the", "que", "der"]
_N = [rf"len(list_filter(string_split_regex(line, '[^\p{{L}}\p{{N}}]+'), lambda x: x = '{w}'))" for w in _WORDS]


@query("stacked_words", f"SELECT doc_id, line_no, CASE WHEN greatest({', '.join(_N)}) >= 2 THEN 'repeat' ELSE 'density' END AS finding FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE length(line) >= 40 AND (greatest({', '.join(_N)}) >= 2 OR {' + '.join(_N)} >= 4)")
def stacked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.stacked_words(read(spark, sf_dir, "documents"), "doc_id", "text", _WORDS).withColumn("line_no", F.col("line_no").cast("long"))


_ANCHOR, _MARKER = r"(?i)licen[sc]ed under", r"(?i)copyright|rights reserved|https?://|[#*$%&|]{3,}"
_FOUND = f"""(SELECT doc_id, cut, coalesce(sum(length(line)) FILTER (WHERE i >= cut), 0)::BIGINT AS tail, sum(length(line))::BIGINT AS whole FROM (SELECT *, min(CASE WHEN a OR (m AND size >= 2) THEN i END) OVER (PARTITION BY doc_id) AS cut FROM (SELECT *, count(*) FILTER (WHERE m) OVER (PARTITION BY doc_id, run) AS size FROM (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
SELECT doc_id, i, line, regexp_matches(line, '{_ANCHOR}') AS a, regexp_matches(line, '{_MARKER}') AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))))) GROUP BY 1, 2)"""
_DECIDED = f"(SELECT *, CASE WHEN cut IS NULL THEN 'none' WHEN tail >= 0.8 * whole THEN 'whole' ELSE 'tail' END AS decision FROM {_FOUND})"


def _injected(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    found = cleaning.injected(read(spark, sf_dir, "documents"), "doc_id", "text", _ANCHOR, _MARKER, keep=keep)
    return found.withColumn("decision", cleaning.injection_decision(F.col("cut"), F.col("share")))


@query("injected_blocks", f"SELECT doc_id, cut::BIGINT AS cut, tail, whole - tail AS body, decision FROM {_DECIDED}")
def injected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir).select("doc_id", F.col("cut").cast("long").alias("cut"), "tail", "body", "decision")


@query("injection_survey", f"SELECT source, decision, count(*) AS n, sum(tail)::BIGINT AS characters FROM {_DECIDED} JOIN documents USING (doc_id) GROUP BY 1, 2")
def injection_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "source").groupBy("source", "decision").agg(F.count("*").alias("n"), F.sum("tail").alias("characters"))


@query("injection_cut", f"SELECT doc_id, md5(CASE WHEN cut IS NULL THEN text ELSE array_to_string(string_split(text, chr(10))[:cut - 1], chr(10)) END) AS digest FROM {_FOUND} JOIN documents USING (doc_id)")
def injection_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "text").select("doc_id", F.md5(cleaning.before_line(F.col("text"), F.col("cut"))).alias("digest"))


@query("paired_rows", """SELECT k, n, a AS left_name, b AS right_name, coalesce(a = b, FALSE) AS agrees FROM (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_returnflag AS a FROM lineitem WHERE l_linenumber < 5)
FULL JOIN (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_returnflag AS b FROM lineitem WHERE l_linenumber <> 2) USING (k, n)""")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_returnflag").alias("name"))
    return joins.paired(lines.where("l_linenumber < 5"), lines.where("l_linenumber <> 2"), "k", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "name")


@query("alias_decisions", """SELECT alias, owner, CASE WHEN n > 1 THEN 'conflict' WHEN alias IN (SELECT p_name FROM part WHERE p_size > 45) THEN 'propose' ELSE 'merge' END AS decision FROM (SELECT string_split(p_name, ' ')[1] || ' ' || p_size AS alias, min(p_brand) AS owner, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 UNION ALL SELECT p_name, min(p_brand), count(DISTINCT p_brand) FROM part WHERE p_size > 44 AND p_brand = 'Brand#1' GROUP BY 1)""")
def alias_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    short = part.select(F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" "), "p_size").alias("alias"), F.col("p_brand").alias("owner"))
    names = part.where("p_size > 44 and p_brand = 'Brand#1'").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("owner"))
    return joins.alias_decisions(short.union(names), part.where("p_size > 45").select(F.col("p_name").alias("name")))


@query("section_ledger", "SELECT conv_id, turn, n FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN length(role) ELSE length(text) END AS n FROM conversations)) WHERE used <= 500")
def section_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    changes = turns.where("turn % 3 = 0").select("conv_id", "turn", F.col("role").alias("text"))
    return upsert.ledger(turns.select("conv_id", "turn", "text"), changes, ["conv_id"], "turn", "text", 500).select("conv_id", "turn", F.length("text").alias("n"))


@query("thread_fingerprint", "SELECT conv_id, sha256(string_agg(turn || '|' || coalesce(role, '-') || '|' || length(text), ';' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def thread_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return upsert.fingerprint(turns, "conv_id", ["turn"], ["turn", "role", "n"])


@query("settings_upsert", "SELECT p_partkey, coalesce(b, p_brand) AS p_brand FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, arg_max(l_shipdate::DATE || '', (l_shipdate, l_orderkey, l_linenumber)) AS b FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY 1) USING (p_partkey)")
def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    changes = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").cast("string").alias("p_brand"), "l_shipdate", "l_orderkey", "l_linenumber")
    return upsert.allowed(part, changes, ["p_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], part.where("p_partkey % 4 = 0"))


@query("member_edges", """WITH old AS (SELECT DISTINCT 'o' || l_orderkey AS a, 's' || l_suppkey AS b, CASE WHEN l_linenumber = 1 THEN 'leads' ELSE 'has' END AS kind FROM lineitem)
SELECT a, b, kind FROM old WHERE NOT (kind = 'has' AND a IN (SELECT 'o' || l_orderkey FROM lineitem WHERE l_orderkey % 10 = 0)) UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || (l_suppkey + 1), 'has' FROM lineitem WHERE l_orderkey % 10 = 0""")
def member_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders' edges to suppliers, of which every tenth order has its members made anew."""
    lines = read(spark, sf_dir, "lineitem").withColumn("a", F.concat(F.lit("o"), "l_orderkey"))
    old = lines.select("a", F.concat(F.lit("s"), "l_suppkey").alias("b"), F.when(F.col("l_linenumber") == 1, "leads").otherwise("has").alias("kind")).distinct()
    groups = lines.where("l_orderkey % 10 = 0").groupBy(F.col("a").alias("node")).agg(F.collect_list(F.concat(F.lit("s"), F.col("l_suppkey") + 1)).alias("members"))
    return graph.rebuilt(old, groups, "has")


@query("first_slots", "SELECT user_id, event_type AS slot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first row of each slot by an aggregate; places among these few
    first = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("slot")).agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return retrieval.ranked(first, ["user_id"], [F.col("at")], "place").select("user_id", "slot", "place")


@query("voice_report", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS chars, round(avg(len(regexp_extract_all(text, '[.!?]'))), 6) AS sentences, round(avg(len(regexp_extract_all(text, '[A-Za-z]{3,}'))), 6) AS ascii_words FROM documents GROUP BY 1")
def voice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    measures = {"chars": F.length(t), "sentences": F.regexp_count(t, F.lit("[.!?]")), "ascii_words": F.regexp_count(t, F.lit("[A-Za-z]{3,}"))}
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(n) for n, c in measures.items()))


@query("stage_context", "SELECT user_id, string_agg(stage || ':' || n, ' > ' ORDER BY stage) AS stages FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 AS stage, count(*) AS n FROM events GROUP BY 1, 2) WHERE stage < 4 GROUP BY 1")
def stage_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was before the stage that is being written, the fifth: earlier stages only, as the layer has them."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    stages = read(spark, sf_dir, "events").groupBy("user_id", F.floor(day / 5).alias("stage")).agg(F.count("*").alias("n")).where("stage < 4")
    parts = F.array_sort(F.collect_list(F.struct("stage", F.concat_ws(":", "stage", "n").alias("part"))))
    return stages.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), " > ").alias("stages"))


@query("coverage_votes", "SELECT o_custkey, n, covered, n >= 10 AND covered < 0.4 * n AS doubtful FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS covered FROM orders GROUP BY 1)")
def coverage_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("hit")).distinct()
    by = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(seen, "o_orderkey", "left").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count("hit").alias("covered"))
    return by.withColumn("doubtful", (F.col("n") >= 10) & (F.col("covered") < F.lit(0.4) * F.col("n")))


@query("numbered_lines", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS no, md5(line) AS line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE trim(line) <> ''")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.trim("line") != "")
    by = Window.partitionBy("conv_id").orderBy("turn", "i")
    return lines.select("conv_id", F.row_number().over(by).alias("no"), F.md5("line").alias("line"))


@query("block_text", "SELECT event_id, user_id AS doc_id, CASE WHEN length(line) > 80 THEN left(line, 80) || '…' ELSE line END AS line FROM events JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) ON doc_id = user_id AND i = event_id % 5 + 1")
def block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 5 + 1).alias("line_no"))
    blocks = cleaning.lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    return refs.join(blocks, ["doc_id", "line_no"]).select("event_id", "doc_id", T.clipped(F.col("line"), 80).alias("line"))


@query("active_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25")
def active_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority like '1%'")
    return rows.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(25).select("o_orderkey")  # a top-k report


@query("entity_cards", "SELECT conv_id, turn, name, CASE WHEN length(text) > 150 THEN left(text, 150) || '…' ELSE text END AS card FROM conversations JOIN (SELECT DISTINCT regexp_extract(trim(text), '^[^ ]+', 0) AS name FROM benchmark) ON contains(text, name) WHERE length(name) > 3")
def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "benchmark").select(F.regexp_extract(F.trim("text"), "^[^ ]+", 0).alias("name")).where(F.length("name") > 3).distinct()
    found = dictionary.contained(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), names, "text", "name")
    return found.select("conv_id", "turn", "name", T.clipped(F.col("text"), 150).alias("card"))


@query("living_members", """SELECT o, coalesce(list(s ORDER BY n, s) FILTER (WHERE b >= 0), []) AS members, coalesce(list(s ORDER BY n, s) FILTER (WHERE b >= 0 AND b < 2000), []) AS notes FROM (SELECT l_orderkey AS o, l_suppkey AS s, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) JOIN (SELECT s_suppkey, s_acctbal AS b FROM supplier) ON s_suppkey = s GROUP BY 1""")
def living_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    lists = lines.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("members"))
    state = F.when(F.col("s_acctbal") < 0, "dead").when(F.col("s_acctbal") < 2000, "dormant").otherwise("alive")
    states = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), state.alias("state"))
    return joins.living(lists, "members", states, ["dead"], ["dormant"], "o")


@query("unmistakable_names", "WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT n_name FROM nation) SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.name <> n.name AND (contains(m.name, n.name) OR contains(n.name, m.name)))")
def unmistakable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("name")).union(part.select("p_brand")).union(part.select("p_name")).union(read(spark, sf_dir, "nation").select("n_name"))
    return joins.unmistakable(names)


@query("guessed_keys", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'cold') THEN 'first' WHEN contains(p_name, 'widget') THEN 'second' END AS guess, trim(replace(replace(p_name, 'widget', ''), 'cold', '')) = '' AS only FROM part")
def guessed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", T.guessed(name, {"first": ["ring", "cold"], "second": ["widget"]}).alias("guess"), T.made_of(name, ["cold", "widget"]).alias("only"))


@query("cleaned_lists", """SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(list(w ORDER BY i) FILTER (WHERE w IS NOT NULL), [])[1:3] END AS words FROM documents d LEFT JOIN (SELECT doc_id, w, min(i) AS i
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) WHERE w IN ('und', 'the', 'que', 'der', 'of') GROUP BY 1, 2) USING (doc_id) GROUP BY 1""")
def cleaned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.cleaned_list(F.split("text", " "), 3, ["und", "the", "que", "der", "of"]).alias("words"))


_SIZED = "(SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) AS position FROM part)"


@query("guarded_rerank", f"SELECT p_partkey, tier::INT AS tier, row_number() OVER (PARTITION BY p_size ORDER BY tier, position) AS new_rank FROM (SELECT *, CASE WHEN first = 'STANDARD' AND p_type = 'STANDARD' AND p_brand LIKE 'Brand#1%' THEN 0 WHEN first = 'STANDARD' AND p_type = 'STANDARD' THEN 1 ELSE 2 END AS tier FROM (SELECT *, first_value(p_type) OVER (PARTITION BY p_size ORDER BY position) AS first FROM {_SIZED}))")
def guarded_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = retrieval.ranked(read(spark, sf_dir, "part"), ["p_size"], [F.col("p_retailprice"), F.col("p_partkey")], "position")
    exact = (F.col("p_type") == "STANDARD") & F.col("p_brand").like("Brand#1%")
    return retrieval.guarded_tiers(part, ["p_size"], "position", "p_type", F.lit("STANDARD"), exact).select("p_partkey", "tier", "new_rank")


@query("near_ties", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY tied DESC, CASE WHEN tied THEN n END NULLS FIRST, CASE WHEN tied THEN o_orderkey END NULLS FIRST, o_totalprice DESC, n, o_orderkey) AS rank FROM (SELECT o_orderkey, o_custkey, o_totalprice, -length(o_orderpriority) AS n, o_totalprice >= max(o_totalprice) OVER (PARTITION BY o_custkey) - 50000 AS tied FROM orders)")
def near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("n", -F.length("o_orderpriority"))
    return retrieval.near_ties(orders, ["o_custkey"], "o_totalprice", 50_000, [F.col("n"), F.col("o_orderkey")]).select("o_orderkey", "rank")


@query("rendered_beats", "SELECT o_custkey, string_agg(o_orderstatus || CASE WHEN n > 1 THEN '×' || n ELSE '' END, ' → ' ORDER BY o_orderstatus) AS beats FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def rendered_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    part = F.concat("o_orderstatus", F.when(F.col("n") > 1, F.concat(F.lit("×"), "n")).otherwise(""))
    return counts.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(part)), " → ").alias("beats"))
