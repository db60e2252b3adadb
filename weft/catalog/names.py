"""Names in texts: dictionaries found and replaced, closures of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog.tables import read
from weft.operators import casting, dictionary
from weft.registry import query

_NAMES = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM benchmark)"
_LONG = f"(SELECT name FROM {_NAMES} WHERE length(name) >= 5)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of five letters or more in benchmark: a dictionary that grows with that table."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name")).distinct()
    return words.where(F.length("name") >= 5)


@query("dictionary_hits", f"SELECT doc_id, len(l) AS n, md5(array_to_string(l, ' ')) AS digest FROM (SELECT doc_id, list_filter((SELECT list(name ORDER BY length(name) DESC, name) FROM {_LONG}), lambda x: contains(text, x)) AS l FROM documents)")
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary.names_in(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", _names(spark, sf_dir), "name")
    return found.select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", " ")).alias("digest"))


@query("dictionary_masked", f"SELECT doc_id, length(t) AS chars, md5(t) AS digest, t <> text AS touched FROM (SELECT doc_id, text, list_reduce(list_prepend(text, (SELECT list(name ORDER BY length(name) DESC, name) FROM {_LONG})), lambda t, n: replace(t, n, '<' || length(n) || '>')) AS t FROM documents)")
def dictionary_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _names(spark, sf_dir).select(F.col("name").alias("original"), F.concat(F.lit("<"), F.length("name"), F.lit(">")).alias("alias"))
    found = dictionary.replaced(read(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], mapping)
    return found.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"), "touched")


@query("phrase_findings", f"""SELECT doc_id, name, n::INT AS n, first::INT AS first, (length(left(text, first)) - length(replace(left(text, first), chr(10), '')) + 1)::INT AS line_no, replace(substring(text, greatest(first - 12, 0) + 1, first - greatest(first - 12, 0) + length(name) + 12), chr(10), ' ') AS context
FROM (SELECT doc_id, text, name, (length(text) - length(replace(text, name, ''))) // length(name) AS n, instr(text, name) - 1 AS first FROM documents JOIN {_LONG} ON contains(text, name))""")
def phrase_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.findings(read(spark, sf_dir, "documents"), "doc_id", "text", _names(spark, sf_dir), "name")


#: The languages of documents, whose books have these parts.
_BOOKS = ["de", "en", "es", "fr"]
_SLOTS = f"(SELECT lang AS book, name AS alias, CASE WHEN name = min(name) OVER (PARTITION BY lang) THEN 'protagonist' ELSE 'part' END AS kind, length(name) AS first FROM (SELECT name, unnest({_BOOKS}) AS lang FROM {_LONG} WHERE length(name) >= 7))"


@query("arc_casts", f"""WITH s AS MATERIALIZED {_SLOTS} SELECT book, arc, alias, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY book, arc ORDER BY kind <> 'protagonist', first, alias) AS rank
FROM (SELECT s.*, doc_id AS arc FROM documents JOIN s ON lang = book AND (kind = 'protagonist' OR (contains(text, alias) AND regexp_matches(text, alias || '([^0-9]|$)'))))) WHERE rank <= 6""")
def arc_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the arcs of their language's book, whose parts are long words of benchmark."""
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("book"), F.col("doc_id").alias("arc"), "text").where("book is not null")
    names = _names(spark, sf_dir).where(F.length("name") >= 7)
    first = names.agg(F.min("name").alias("least"))
    kinds = names.join(F.broadcast(first), F.col("name") == F.col("least"), "left").select(F.col("name").alias("alias"), F.when(F.col("least").isNotNull(), "protagonist").otherwise("part").alias("kind"), F.length("name").alias("first"))
    slots = kinds.withColumn("book", F.explode(F.lit(_BOOKS)))
    return casting.arc_casts(docs, slots, 6)


_TRAITS = ["altruism", "honor", "mercy", "resolve"]
_V = [f"CASE WHEN vec_id % 7 <> {i} THEN embedding[{i + 1}]::DOUBLE * 80 END" for i in range(4)]
_W = [f"CASE WHEN {v} IS NULL THEN 0 ELSE least(greatest(round_even({v}, 0), -10), 10) END" for v in _V]
_T = [w if i % 2 == 0 else f"CASE WHEN abs({w}) > 4 THEN sign({w}) ELSE {w} END" for i, w in enumerate(_W)]


@query("settled_traits", f"SELECT vec_id, {', '.join(f'({t})::INT AS {n}' for t, n in zip(_T, _TRAITS, strict=True))}, ({' + '.join(f'CASE WHEN abs({v}) > 10 THEN 1 ELSE 0 END' for v in _V)})::INT AS clamped, ({' + '.join(f'CASE WHEN abs({w}) > 4 THEN 1 ELSE 0 END' for w in _W[1::2])})::INT AS inferred, ({' + '.join(f'CASE WHEN {v} IS NULL THEN 1 ELSE 0 END' for v in _V)})::INT AS missing FROM embeddings")
def settled_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers of each vector as traits, the second and fourth of them inferred, one of some missing."""
    value = lambda i: F.when(F.col("vec_id") % 7 != i, F.get("embedding", F.lit(i)).cast("double") * 80)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.create_map(*(x for i, n in enumerate(_TRAITS) for x in (F.lit(n), value(i)))).alias("v"), F.create_map(*(x for i, n in enumerate(_TRAITS) for x in (F.lit(n), F.lit("slot" if i % 2 else "text")))).alias("b"))
    found = casting.settled_traits(rows, "vec_id", _TRAITS, "v", "b")
    return found.select("vec_id", *(F.element_at("traits", n).alias(n) for n in _TRAITS), "clamped", "inferred", "missing")
