"""Text quality, cleaning, de-duplication, chunking and sequence queries over documents, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog.tables import read
from weft.functions import text as T
from weft.operators import cleaning, dedup, dictionary, intervals, joins, sequences, style, templates, windows
from weft.registry import query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query("token_estimates", "SELECT doc_id, floor(length(text) / 1.5)::BIGINT AS trunc, round_even(length(text) / 1.5, 0)::BIGINT AS even, floor(greatest(n_chars, 0) * 0.7::DOUBLE)::BIGINT AS by_chars FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", T.tokens_trunc(t).alias("trunc"), T.tokens_even(t).alias("even"), T.tokens_by_chars(F.col("n_chars")).alias("by_chars"))


@query("exact_dup_fingerprint", "SELECT doc_id, source, count(*) OVER w AS n_copies, row_number() OVER (PARTITION BY source, f ORDER BY doc_id) = 1 AS keep FROM (SELECT *, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS f FROM documents) WINDOW w AS (PARTITION BY source, f)")
def exact_dup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only ids and digests are shuffled
    rows = _documents(spark, sf_dir).select("doc_id", "source", T.fingerprint(F.col("text")).alias("f"))
    return dedup.mark(rows, F.col("f"), ["doc_id"], ["source"]).select("doc_id", "source", "n_copies", "keep")


@query("merge_identical", "SELECT arg_min(text, doc_id) AS text, list_transform(list_sort(list([o, s])), lambda x: x[2]) AS sources, sum(n)::BIGINT AS n FROM (SELECT regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS norm, printf('%020d', min(doc_id)) AS o, source AS s, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1, 3) GROUP BY norm")
def merge_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.merge_identical(_documents(spark, sf_dir), "text", "source", "doc_id")


@query("text_metrics", "SELECT doc_id, length(text) AS chars, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS paragraphs, regexp_count(text, '[.!?]') AS sentences FROM (SELECT *, len(regexp_extract_all(text, '[.!?]')) AS c FROM documents)".replace("regexp_count(text, '[.!?]')", "c"))
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.length("text").alias("chars"), F.size(T.paragraphs(F.col("text"))).alias("paragraphs"), F.regexp_count("text", F.lit("[.!?]")).alias("sentences"))


@query("gram_repeats", "SELECT doc_id, CASE WHEN length(text) >= 4 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0.0 END AS repeated FROM (SELECT doc_id, text, list_transform(range(1, greatest(length(text) - 2, 1)), lambda i: substring(text, i, 4)) AS g FROM documents)")
def gram_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.repeated_gram_share(F.col("text"), 4).alias("repeated"))


@query("neighbour_jaccard", "SELECT doc_id, next, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 9) AS similarity FROM (SELECT doc_id, lead(doc_id) OVER w AS next, list_distinct(string_split(text, '')) AS a, list_distinct(string_split(lead(text) OVER w, '')) AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE next IS NOT NULL")
def neighbour_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "source", F.array_distinct(T.chars(F.col("text"))).alias("a"))
    pairs = intervals.with_next(rows, "source", "doc_id").where("next is not null").join(rows.select(F.col("doc_id").alias("next"), F.col("a").alias("b")), "next")
    return pairs.select("doc_id", "next", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("bigram_relevance", "SELECT item_id, doc_id, len(list_filter(g, lambda x: contains(text, x))) / len(g) AS relevance FROM (SELECT item_id, list_distinct(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) AS g FROM benchmark WHERE item_id % 50 = 0) JOIN documents ON TRUE")
def bigram_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", F.col("text").alias("q"))
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return docs.join(F.broadcast(queries)).select("item_id", "doc_id", T.gram_relevance(F.col("text"), F.col("q")).alias("relevance"))  # the stated query set


@query("leak_scan", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").withColumnRenamed("text", "phrase")
    return dictionary.contained(_documents(spark, sf_dir).select("doc_id", "text"), items).select("doc_id", "item_id")


_CLASS = r"""CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '(?i)^\s*(licen[sc]ed under|copyright|all rights reserved|\(c\)).*$') THEN 'licence' WHEN regexp_matches(line, '(?i)^\s*(https?://|www\.)\S+\s*$') THEN 'link' WHEN regexp_matches(line, '^[^\p{L}\p{N}]*$') THEN 'junk' ELSE 'body' END"""
_RULES = tuple(r for r in cleaning.LINE_RULES if r.name != "rule")  # DuckDB's patterns have no back-references


@query("line_classes", f"SELECT doc_id, {_CLASS} AS line_class, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.class_counts(_documents(spark, sf_dir), "doc_id", "text", _RULES)


@query("clean_body", f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda line: {_CLASS} IN ('blank', 'body')), chr(10)), '') AS t FROM documents)")
def clean_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = cleaning.body(F.col("text"), _RULES)
    return _documents(spark, sf_dir).select("doc_id", F.length(body).alias("chars"), F.md5(body).alias("digest"))


@query("inline_residue", r"""SELECT page_id, len(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS mail, len(regexp_extract_all(h1, 'https?://[^\s<>"]+')) AS link, len(regexp_extract_all(h2, '[#*$%&|]{3,}')) AS symbols, len(regexp_extract_all(h3, '&[a-z]+;')) AS entity, md5(regexp_replace(h3, '&[a-z]+;', '', 'g')) AS digest
FROM (SELECT *, regexp_replace(h2, '[#*$%&|]{3,}', '', 'g') AS h3 FROM (SELECT *, regexp_replace(h1, 'https?://[^\s<>"]+', '', 'g') AS h2 FROM (SELECT *, regexp_replace(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g') AS h1 FROM pages)))""")
def inline_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, hits = cleaning.inline(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", *(n.alias(k) for k, n in hits.items()), F.md5(rest).alias("digest"))


@query("ladder_decide", r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS words, len(regexp_extract_all(text, '[#*$%&|<>]')) / greatest(length(text), 1) AS symbols, count(*) OVER (PARTITION BY md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'))) AS copies, len(regexp_extract_all(text, 'https?://[^\s<>"]+')) AS hits FROM documents)
SELECT doc_id, CASE WHEN words = 0 THEN 'empty' WHEN words < 10 THEN 'short' WHEN symbols > 0.1 THEN 'symbols' WHEN copies > 1 THEN 'copy' WHEN hits > 0 THEN 'noise' ELSE 'none' END AS reason FROM s""")
def ladder_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _documents(spark, sf_dir).select("doc_id", F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("words"), (F.regexp_count(t, F.lit("[#*$%&|<>]")) / F.greatest(F.length(t), F.lit(1))).alias("symbols"), T.fingerprint(t).alias("f"), F.regexp_count(t, F.lit(r"https?://[^\s<>\"]+")).alias("hits"))
    rows = dedup.mark(rows, F.col("f"), ["doc_id"])
    return rows.select("doc_id", cleaning.quarantine(F.col("words"), F.col("symbols"), F.lit(0), F.col("n_copies"), F.col("hits")).alias("reason"))


@query("last_lines", r"""SELECT doc_id, CASE WHEN l IS NULL THEN 'empty' WHEN regexp_matches(l, '(?i)(to be continued|stay tuned|see you|thanks for reading)') THEN 'author_talk' WHEN regexp_matches(trim(l), '[.!?…"''”’)\]]$') THEN 'clean' ELSE 'truncated' END AS state FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-1] AS l FROM documents)""")
def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", cleaning.last_line(F.col("text")).alias("state"))


@query("repeated_lines", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40 GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_lines(_documents(spark, sf_dir), "doc_id", "text")


@query("adjacent_overlap", "SELECT source, doc_id, next, round(len(list_intersect(a, b)) / least(len(list_distinct(a)), len(list_distinct(b))), 9) AS ratio FROM (SELECT source, doc_id, lead(doc_id) OVER w AS next, string_split(text, chr(10)) AS a, string_split(lead(text) OVER w, chr(10)) AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE next IS NOT NULL AND len(list_intersect(a, b)) / least(len(list_distinct(a)), len(list_distinct(b))) >= 0.5")
def adjacent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("source", "doc_id", F.split("text", "\n").alias("lines"))
    return dedup.adjacent_overlap(rows, "source", "doc_id", "lines", 0.5).withColumn("ratio", F.round("ratio", 9))


@query("summaries", r"""SELECT doc_id, coalesce(CASE WHEN length(p) > 220 THEN left(p, 220) || '…' ELSE p END, '') AS summary FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 10 AND NOT regexp_matches(x, '^(#|---|===|\|)'))[1] AS p FROM documents)""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("source_digest", "SELECT source, CASE WHEN length(t) > 500 THEN left(t, 500) || '…' ELSE t END AS digest FROM (SELECT source, string_agg(left(text, 60), '；' ORDER BY doc_id) AS t FROM documents GROUP BY source)")
def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 501 characters are at most 501 parts, so the first parts of each source are enough: no group is collected whole
    first = windows.top(_documents(spark, sf_dir).select("source", "doc_id", F.substring("text", 1, 60).alias("part")), ["source"], [F.col("doc_id")], 502)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "part"))), lambda x: x["part"])
    return first.groupBy("source").agg(T.joined(parts).alias("digest"))


@query("masked_names", "SELECT c_custkey, replace(replace(replace(c_name, 'Customer#', 'C-'), 'Customer', 'c'), '000', '0') AS name, '***' || right(trim(c_name), 4) AS masked FROM customer")
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", T.longest_first(name, [("000", "0"), ("Customer", "c"), ("Customer#", "C-")]).alias("name"), T.masked_key(name).alias("masked"))


@query("alias_numbering", "SELECT c_custkey, c_mktsegment || '-' || row_number() OVER (PARTITION BY c_mktsegment, c_acctbal >= 0 ORDER BY c_custkey) || CASE WHEN c_acctbal >= 0 THEN 'f' ELSE 'e' END AS alias FROM customer")
def alias_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") >= 0).alias("full"))
    rows = windows.numbered(rows, ["c_mktsegment", "full"], "c_custkey", "n")
    return rows.select("c_custkey", F.concat("c_mktsegment", F.lit("-"), "n", F.when(F.col("full"), "f").otherwise("e")).alias("alias"))


@query("window_specs", "SELECT source, lo, least(lo + 9, last) AS core_end, least(lo + 12, last) AS need FROM (SELECT source, last, unnest(range(first, last + 1, 10)) AS lo FROM (SELECT source, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY source))")
def window_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _documents(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return intervals.windows(spans, 10, 3).select("source", "lo", "core_end", "need")


@query("arcs_from_cuts", "SELECT source, doc_id AS lo, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) - 1, last) AS hi FROM (SELECT source, doc_id, max(doc_id) OVER (PARTITION BY source) AS last, text FROM documents) WHERE length(text) > 3000")
def arcs_from_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as its chapters: one of over 3,000 characters begins an arc, the others follow in it."""
    rows = _documents(spark, sf_dir).select("source", "doc_id", F.length("text").alias("n"))
    last = rows.groupBy("source").agg(F.max("doc_id").alias("last"))
    return intervals.from_cuts(rows.where("n > 3000").join(last, "source"), "source", "doc_id", "last")


@query("coverage_report", "SELECT o_custkey, count(*) AS covered, count(*) FILTER (WHERE n > 1) AS doubled FROM (SELECT o_custkey, d, count(*) AS n FROM (SELECT o_custkey, unnest(range(x, x + 15)) AS d FROM (SELECT o_custkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS x FROM orders)) GROUP BY 1, 2) GROUP BY 1")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return intervals.coverage(read(spark, sf_dir, "orders").select("o_custkey", day.alias("lo"), (day + 14).alias("hi")), "o_custkey")


@query("glued_lines", "SELECT doc_id, part::BIGINT AS part, string_agg(line, '' ORDER BY i) AS line FROM (SELECT *, sum(CASE WHEN length(line) >= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE part > 0 GROUP BY 1, 2")
def glued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.lines(_documents(spark, sf_dir), "doc_id", "text")
    return intervals.glued(rows, "doc_id", "line_no", "line")


@query("chunk_pack")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.chunks(_documents(spark, sf_dir), "doc_id", "text")


@query("token_batches")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a conversation is one key: turns of one are few
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens_by_chars(F.length("text")).alias("tokens"))
    return intervals.batches(rows, "conv_id", "turn", "tokens", 5, 400)


@query("repair_partition")
def repair_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return intervals.repaired(read(spark, sf_dir, "orders").select("o_custkey", day.alias("lo"), (day + 60).alias("hi"), F.lit(0).alias("first"), F.lit(2600).alias("last")), "o_custkey")


def _symbols(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("a"))


@query("sequence_align")
def sequence_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    # users with an even number and the ones behind them: an equi-join, not a window
    seqs = _symbols(read(spark, sf_dir, "events").where("user_id is not null"), "user_id")
    pairs = seqs.where("user_id % 2 = 0").join(seqs.where("user_id % 2 = 1").select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")
    return sequences.aligned(pairs, "a", "b").select("user_id", "common", "merged", "at", "mergeable")


@query("sequence_clusters")
def sequence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _symbols(read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "day")
    return sequences.clustered(days, "user_id", "day", "a").select("user_id", "day", "cluster", "attached")


def _day_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as sequences of what happened, purchases as their cores, with a tag for each event's value and number."""
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    tags = F.array(F.when(F.col("value") > 100, "high").otherwise("low"), F.concat(F.lit("k"), F.col("event_id") % 3))
    by = events.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", tags.alias("tags")))).alias("e"))
    days = by.select("user_id", "day", F.transform("e", lambda x: x["event_type"]).alias("a"), F.transform("e", lambda x: x["tags"]).alias("tags"))
    return templates.members(days.withColumn("cores", F.filter(F.array_distinct("a"), lambda x: x == "purchase")), "user_id", "day", "a", "tags", "cores")


@query("skeleton_templates")
def skeleton_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.templates(_day_members(spark, sf_dir), "user_id", "day")


@query("repeated_tail")
def repeated_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.without_repeated_tail(_documents(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", "n_cut", F.length("text").alias("chars"))


@query("notice_tail")
def notice_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "text")
    return cleaning.without_tail_block(rows, "text", r"(?i)licen[sc]ed under", r"(?i)copyright|rights reserved|https?://").select("doc_id", "n_tail", F.length("text").alias("chars"))


@query("style_scores")
def style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return style.score(style.scan(docs, "doc_id", "text"), docs, "doc_id", "text")


@query("json_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.functions import parsing

    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(parsing.parsed("props"), "$.k").try_cast("long").alias("k"))
