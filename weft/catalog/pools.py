"""Pools of entries, owners, references turned into edges, extracts put in shape, tails cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog.retrieval import _EDGES, _edges
from weft.catalog.tables import read
from weft.functions import parsing
from weft.operators import cleaning, graph, pools
from weft.registry import query

_ENTRIES = "(SELECT p_partkey AS id, p_name AS name, [string_split(p_name, ' ')[1]] AS aliases, p_type AS category, p_brand AS genre, CASE WHEN p_size < 45 THEN 'active' ELSE 'disabled' END AS status, p_size % 7 = 0 AS reference_only FROM part)"
_SEEN = f"(SELECT * FROM {_ENTRIES} WHERE status = 'active' AND NOT reference_only)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") < 45, "active").otherwise("disabled")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.slice(F.split("p_name", " "), 1, 1).alias("aliases"), F.col("p_type").alias("category"), F.col("p_brand").alias("genre"), status.alias("status"), (F.col("p_size") % 7 == 0).alias("reference_only"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), "s_suppkey")).alias("aliases"), F.lit("active").alias("status"), F.lit(False).alias("reference_only"))


@query("pool_visible", f"SELECT id, name FROM {_SEEN} WHERE genre IN ('Brand#1', 'Brand#2') AND category = 'STANDARD'")
def pool_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.visible(_entries(spark, sf_dir), ["Brand#1", "Brand#2"], "STANDARD").select("id", "name")


@query("pool_lookup", f"""WITH asked AS (SELECT DISTINCT trim(name) AS name FROM (SELECT name FROM {_ENTRIES} UNION ALL SELECT string_split(name, ' ')[1] FROM {_ENTRIES} UNION ALL SELECT 'S' || s_suppkey FROM supplier UNION ALL SELECT ' ' || s_name FROM supplier UNION ALL SELECT n_name FROM nation)),
known AS (SELECT name, 0 AS way, 'item' AS kind, id FROM {_ENTRIES} WHERE status = 'active' UNION ALL SELECT unnest(aliases), 1, 'item', id FROM {_ENTRIES} WHERE status = 'active' UNION ALL SELECT s_name, 2, 'person', s_suppkey FROM supplier UNION ALL SELECT 'S' || s_suppkey, 3, 'person', s_suppkey FROM supplier)
SELECT name, arg_min(kind, (way, id)) AS kind, arg_min(id, (way, id)) AS id FROM asked JOIN known USING (name) GROUP BY 1""")
def pool_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, people = _entries(spark, sf_dir), _people(spark, sf_dir)
    asked = items.select("name").union(items.select(F.element_at("aliases", 1))).union(people.select(F.concat(F.lit("S"), "id"))).union(people.select(F.concat(F.lit(" "), "name"))).union(read(spark, sf_dir, "nation").select("n_name"))
    return pools.looked_up(asked, {"item": items, "person": people})


@query("pool_blocks", f"SELECT genre, 'Use these names:' || chr(10) || string_agg(category || ': ' || names, chr(10) ORDER BY category) AS block FROM (SELECT genre, category, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY genre, category ORDER BY name) AS r FROM (SELECT DISTINCT genre, category, name FROM {_SEEN})) WHERE r <= 8 GROUP BY 1, 2) GROUP BY 1")
def pool_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.injection_block(pools.offered(pools.visible(_entries(spark, sf_dir)), "genre", 8), "genre", "Use these names:")


@query("pool_stats", f"SELECT 'item' AS kind, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE reference_only) AS reference_only FROM {_ENTRIES} UNION ALL SELECT 'person', count(*), count(*), 0 FROM supplier")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.pool_stats({"item": _entries(spark, sf_dir), "person": _people(spark, sf_dir)})


@query("seeded_sample", f"SELECT genre, id FROM (SELECT genre, id, row_number() OVER (PARTITION BY genre ORDER BY md5('7-' || id), id) AS r FROM {_SEEN}) WHERE r <= 5")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.sampled(pools.visible(_entries(spark, sf_dir)), ["genre"], "id", 5, 7).select("genre", "id")


@query("key_vocabulary", "SELECT p_type, list(DISTINCT p_name ORDER BY p_name) AS words FROM part GROUP BY 1")
def key_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.vocabulary(read(spark, sf_dir, "part"), "p_type", "p_name")


@query("source_catalogue", "SELECT source, rank, doc_id, chars, tokens FROM (SELECT source, doc_id, length(text) AS chars, floor(length(text) / 1.5)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality = 1, FALSE) DESC, doc_id) AS rank FROM documents LEFT JOIN labels USING (doc_id)) WHERE rank <= 25")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 documents of each source for a reader to choose from, well labelled ones first."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("chars"), F.floor(F.length("text") / 1.5).alias("tokens"))
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("locked"))
    return pools.catalogued(docs.join(labels, "doc_id", "left"), "source", "doc_id", "locked", 25).select("source", "rank", "doc_id", "chars", "tokens")


@query("owner_edges", """WITH found AS (SELECT o_custkey AS place, l_partkey AS thing, 'Supplier#' || lpad((l_suppkey + l_linenumber % 3)::VARCHAR, 9, '0') AS owner FROM lineitem JOIN orders ON o_orderkey = l_orderkey), present AS (SELECT DISTINCT o_custkey AS place, s_name AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey % 3 > 0)
SELECT DISTINCT id AS a, thing AS b, 'owns' AS kind FROM found f JOIN (SELECT s_name AS owner, min(s_suppkey) AS id FROM supplier GROUP BY 1) USING (owner) WHERE place NOT IN (SELECT place FROM present) OR EXISTS (SELECT 1 FROM present p WHERE p.place = f.place AND p.name = f.owner)""")
def owner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts found with an owner in customers' orders, of which every third customer has no list of those present."""
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("place")), "l_orderkey")
    owner = F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") + F.col("l_linenumber") % 3).cast("string"), 9, "0"))
    present = lines.where("place % 3 > 0").join(suppliers, F.col("l_suppkey") == F.col("id")).select("place", "name")
    return graph.owner_edges(lines.select("place", F.col("l_partkey").alias("thing"), owner.alias("owner")), present, suppliers, "place", "owns")


@query("references_to_edges", """WITH old AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, 'sells' AS kind FROM lineitem WHERE l_returnflag = 'A'), refs AS (SELECT l_partkey AS a, l_suppkey AS b, 'sells' AS kind FROM lineitem UNION ALL SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey END, 'lives' FROM supplier)
SELECT kind, (SELECT count(*) FROM (SELECT DISTINCT a, b, kind FROM refs WHERE b IS NOT NULL EXCEPT SELECT * FROM old) n WHERE n.kind = r.kind) AS made, count(*) FILTER (WHERE b IS NULL) AS skipped FROM refs r GROUP BY 1""")
def references_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and homes as edges beside those of returned parts, which are there already."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    old = lines.where("l_returnflag = 'A'").select("a", "b", F.lit("sells").alias("kind")).distinct()
    homes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).cast("long").alias("b"))
    return graph.from_references(old, {"sells": lines, "lives": homes})[1]


@query("graph_blocks", f"""WITH near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank FROM {_EDGES} WHERE CAST(a[2:] AS BIGINT) % 50 = 0) WHERE rank <= 12), told AS (SELECT a AS node, rank, s_name AS name, s_acctbal < 0 AS dead FROM near JOIN supplier ON 's' || s_suppkey = b),
l AS (SELECT node, dead, string_agg(name, ', ' ORDER BY rank) AS names FROM told GROUP BY 1, 2) SELECT node, string_agg(CASE WHEN dead THEN '†: ' ELSE 'buys: ' END || names, chr(10) ORDER BY dead) AS block FROM l GROUP BY 1""")
def graph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read(spark, sf_dir, "orders").where("o_custkey % 50 = 0").select(F.concat(F.lit("c"), "o_custkey").alias("node")).distinct()
    names = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("dead"))
    return graph.injection(seeds, _edges(spark, sf_dir), names, {"buys": 12})


@query("trimmed_tails", r"""SELECT doc_id, md5(CASE WHEN regexp_matches(k, '[,;:，、；：]$') THEN regexp_replace(k, '[,;:，、；：]+$', '') || '.' ELSE k END) AS digest FROM (SELECT doc_id, text, length(m) AS n, rtrim(left(text, length(text) - length(m)), ' ') AS k FROM (SELECT doc_id, text, regexp_extract(text, '(?s)(https?://|(?:[#*$%&|]){3}).*$', 0) AS m FROM documents)) WHERE n > 0 AND n <= 400 AND k <> ''""")
def trimmed_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose last 400 characters begin with a link or a run of symbols, without them."""
    cut = cleaning.trimmed_tail(F.col("text"), r"https?://|[#*$%&|]{3}", 400)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(cut).alias("digest")).where("digest is not null")


@query("shaped_extracts", """SELECT o_orderkey, o_orderpriority AS summary, list(l_shipdate::DATE::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)[1:3] AS days, coalesce(list(CASE WHEN l_returnflag = 'A' THEN 'bury' WHEN l_returnflag = 'R' THEN 'hint' ELSE 'hint' END || ':' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate), [])[1:4] AS actions,
coalesce(list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) FILTER (WHERE l_linestatus = 'O'), [])[1:2] AS entities FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def shaped_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON extracts of uneven shape (an action as an object, or as a text; kinds that aren't allowed), read back."""
    flag = F.col("l_returnflag")
    action = F.when(flag == "A", F.to_json(F.struct(F.lit("bury").alias("action"), F.col("l_partkey").alias("desc")))).when(flag == "R", F.to_json(F.struct(F.col("l_partkey").alias("description")))).otherwise(F.concat(F.lit('" '), "l_partkey", F.lit('"')))
    entity = F.to_json(F.struct(F.when(F.col("l_linestatus") == "O", "Item").otherwise("rumour").alias("kind"), F.concat(F.lit(" "), "l_suppkey").alias("name")))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.concat(F.lit('" '), F.to_date("l_shipdate").cast("string"), F.lit('"')).alias("day"), action.alias("action"), entity.alias("entity"))
    by = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    listed = lambda f, n: F.concat(F.lit(f', "{n}": ['), F.array_join(F.transform("x", lambda r: r[f]), ", "), F.lit("]"))
    lists = F.concat(listed("day", "days"), listed("action", "actions"), listed("entity", "entities"))
    data = F.concat(F.lit('{"summary": "'), "o_orderpriority", F.lit(' "'), lists, F.lit("}"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(by, "o_orderkey").select("o_orderkey", data.alias("data"))
    d = F.col("data")
    told = F.transform(parsing.actions(d, "actions", 4), lambda a: F.concat_ws(":", a["action"], a["what"]))
    return rows.select("o_orderkey", F.trim(F.get_json_object(d, "$.summary")).alias("summary"), parsing.text_list(d, "days", 3).alias("days"), told.alias("actions"), F.transform(parsing.entities(d, "entities", ["item", "character"], 2), lambda e: e["name"]).alias("entities"))
