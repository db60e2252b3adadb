"""How filters interact: what each removes, alone and after others, in every order, for each part of the corpus.

A document is a number for each filter that it fails and each label that it has. Every task packs these into bitsets of
NumPy words, a bit for each row: one for each filter, each label and each part that it sees. For each of the 2^k sets of
filters that can stand before a filter, the rows that are still there are found by AND-NOT of the set's bitsets, and
counted for each part and label by popcounts. Counts are summed over all tasks; whatever an order of filters asks for is
then a difference of two of them, as what a prefix leaves doesn't depend on the order within it.

The rows that a task holds at a time are those of one Arrow batch; what leaves it are 2^k rows of counts for each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 4096


def _bits(flags: np.ndarray, words: int) -> np.ndarray:
    """flags as a bitset of `words` 64-bit words, filled up with zeros."""
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags)
    out[: len(packed)] = packed
    return out.view(np.uint64)


def prefix_counts(rows: DataFrame, filters: int, labels: list[str]) -> DataFrame:
    """part, prefix, kept and a column for each label: rows (part string, fails int, and a boolean for each label) that pass
    all filters of `prefix`, a number with a bit for each of them, like `fails`.

    Every part has all prefixes, zeros included. A null part is an empty one, null flags are false and null fails are none.
    """
    sets = 1 << filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def done() -> pa.RecordBatch:
            names = np.repeat(np.array(list(held), dtype=object), sets)
            counts = np.concatenate(list(held.values()))
            columns = [pa.array(names, pa.string()), pa.array(np.tile(np.arange(sets, dtype=np.int32), len(held)))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[:, i]) for i in range(1 + len(labels)))], ["part", "prefix", "kept", *labels])

        for batch in batches:
            words = -(-batch.num_rows // 64)
            if not words:
                continue
            fails = batch.column("fails").fill_null(0).to_numpy(zero_copy_only=False)
            failing = [_bits(fails >> f & 1, words) for f in range(filters)]
            marked = [_bits(batch.column(x).fill_null(False).to_numpy(zero_copy_only=False), words) for x in labels]
            parts = batch.column("part").fill_null("").dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            names = parts.dictionary.to_pylist()
            here = [_bits(codes == c, words) for c in range(len(names))] if len(names) <= words else None
            counts = np.zeros((len(names), sets, 1 + len(labels)), np.int64)
            alive = [_bits(np.ones(batch.num_rows, bool), words)]
            for s in range(1, sets):  # a set is the set without its lowest filter, and that filter
                alive.append(alive[s & (s - 1)] & ~failing[(s & -s).bit_length() - 1])
            for s, left in enumerate(alive):
                for i, counted in enumerate((left, *(left & m for m in marked))):
                    if here is None:  # about as many parts as rows: one pass over the rows instead of one for each part
                        rows_left = np.unpackbits(counted.view(np.uint8), count=len(codes)).view(bool)
                        counts[:, s, i] = np.bincount(codes[rows_left], minlength=len(names))
                    else:
                        counts[:, s, i] = [int(np.bitwise_count(counted & p).sum()) for p in here]
            for name, own in zip(names, counts, strict=True):
                held[name] = held[name] + own if name in held else own
            if len(held) > HELD_PARTS:
                yield done()
                held.clear()
        if held:
            yield done()

    counted = rows.select("part", "fails", *labels).mapInArrow(run, "part string, prefix int, kept long, " + ", ".join(f"{x} long" for x in labels))
    return counted.groupBy("part", "prefix").agg(*(F.sum(x).alias(x) for x in ("kept", *labels)))


def orders_report(counts: DataFrame, letters: str, labels: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost and shapley from prefix_counts, for all
    orders of the filters named by `letters`.

    shapley is the sum of what the step's filter removes, over all orders: for each set before it, |set|! (k - 1 - |set|)!
    times what it removes there.
    """
    k, every = len(letters), (1 << len(letters)) - 1
    cells = F.map_from_entries(F.collect_list(F.struct("prefix", F.struct("kept", *labels))))
    by = counts.groupBy("part").agg(cells.alias("at"))
    bit = {x: 1 << i for i, x in enumerate(letters)}

    def removed(before: int, f: str) -> Column:
        return F.col("at")[before]["kept"] - F.col("at")[before | bit[f]]["kept"]

    def shapley(f: str) -> Column:
        sets = [s for s in range(every + 1) if not s & bit[f]]
        return sum((removed(s, f) * (math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())) for s in sets), F.lit(0))

    alone = F.create_map(*(x for f in letters for x in (F.lit(f), F.struct(removed(0, f).alias("fails"), removed(every & ~bit[f], f).alias("unique"), shapley(f).alias("shapley")))))
    orders = F.explode(F.lit(["".join(p) for p in permutations(letters)]))
    steps = by.withColumn("alone", alone).withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = {f: F.locate(f, F.col("filter_order")) for f in letters}
    upto = lambda last: sum((F.when(place[f] <= last, bit[f]).otherwise(0) for f in letters), F.lit(0))
    steps = steps.withColumns({"a": F.col("at")[upto(F.col("step") - 1)], "b": F.col("at")[upto(F.col("step"))], "own": F.col("alone")[F.substring("filter_order", F.col("step"), F.lit(1))]})
    removed_here = F.col("a.kept") - F.col("b.kept")
    return steps.select("part", "filter_order", "step", F.col("b.kept").alias("kept"), removed_here.alias("removed"), (F.col("own.fails") - removed_here).alias("redundant"), F.col("own.unique").alias("unique_fails"),
                        *((F.col(f"a.{x}") - F.col(f"b.{x}")).alias(f"{x}_lost") for x in labels), F.col("own.shapley").alias("shapley"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits 0 to 3: the filters A to D), digest and a number `uid` of each row of docs.

    Words are split once; nothing but lengths and counts leaves the JVM's row.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    n, chars, capitals = F.size("words").cast("long"), F.length("text").cast("long"), F.length("text").cast("long") - F.length(F.translate("text", upper, ""))
    fails = [n < 100, F.size(F.array_distinct("words")).cast("long") * 100 < n * 80, capitals * 100 > chars * 10, F.col("text").rlike(r"[#$%&*|]")]
    number = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", number.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("uid"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: the five filters A
    (under 100 words), B (under 80 % distinct words), C (over 10 % capitals), D (holds one of #$%&*|) and E (the text of a
    smaller doc_id) on whole texts of docs (doc_id, text, lang).

    Null texts are empty ones, and equal to these; a null lang is the empty part. A row with a null doc_id never fails E,
    has no label, and makes no other row fail. Rows of one doc_id and text are counted each, and none of them fails E by the
    others. labels (doc_id, quality, toxic) may repeat: a document is good (toxic) if one of its rows says 1. Other columns
    are not read. An empty table gives an empty one.
    """
    rows = common.stored(failures(docs), "audit-rows")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    good, toxic = F.coalesce(F.max(F.col("quality") == 1), F.lit(False)), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False))
    known = labels.where("(quality = 1 or toxic = 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"), toxic.alias("toxic"))
    marked = common.salted_join(rows, copies, "digest", "uid")
    # rows without an id have no label; they are dealt by their number
    spread = F.when(F.col("doc_id").isNull(), F.col("uid") % 4096).otherwise(0)
    joined = marked.withColumn("__s", spread).join(known.withColumn("__s", F.lit(0).cast("long")), ["doc_id", "__s"], "left")
    repeats = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    counts = prefix_counts(joined.select("part", F.col("fails").bitwiseOR(repeats).alias("fails"), "good", "toxic"), 5, ["good", "toxic"])
    return orders_report(counts, "ABCDE", ["good", "toxic"])


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audited over all documents and labels."""
    return audited(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, coalesce(max(quality) FILTER (WHERE quality = 1), 0) AS good, coalesce(max(toxic) FILTER (WHERE toxic = 1), 0) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest([1, 2, 4, 8, 16]) AS b, unnest(['A', 'B', 'C', 'D', 'E']) AS s),
o AS (SELECT a.s || b.s || c.s || d.s || e.s AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS p FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
z AS (SELECT filter_order, step, p[step] AS b, coalesce(list_sum(p[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, b, sum(n) FILTER (WHERE m & (before | b) = 0) AS kept, sum(n) FILTER (WHERE m & before = 0 AND m & b > 0) AS removed,
  sum(n) FILTER (WHERE m & before > 0 AND m & b > 0) AS redundant, sum(n) FILTER (WHERE m = b) AS unique_fails,
  sum(good) FILTER (WHERE m & before = 0 AND m & b > 0) AS good_lost, sum(toxic) FILTER (WHERE m & before = 0 AND m & b > 0) AS toxic_lost FROM c, z GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, b)::BIGINT AS shapley FROM r
"""
