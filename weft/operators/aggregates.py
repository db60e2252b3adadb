"""Aggregations: usage buckets, score and feedback statistics, rollups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import windows

UNKNOWN = "(none)"


def usage_bucket() -> list[Column]:
    """Calls, tokens, cache hits and misses, their rate (null if nothing was tracked), estimates and failures.

    Over the columns prompt, completion, total, hit, miss, estimated, ok.
    """
    sums = [F.sum(c).alias(f"{c}_tokens") for c in ("prompt", "completion", "total", "hit", "miss")]
    rate = F.try_divide(F.sum("hit"), F.sum("hit") + F.sum("miss")).alias("hit_rate")
    return [F.count("*").alias("calls"), *sums, rate, F.count_if("estimated").alias("estimated_calls"), F.count_if(~F.col("ok")).alias("failed_calls")]


def usage(log: DataFrame, *keys: str) -> DataFrame:
    """The bucket for each combination of keys; a null key is shown as (none)."""
    return log.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit(UNKNOWN)).alias(k) for k in keys)).agg(*usage_bucket())


def usage_sets(log: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket over all rows and for each key by itself in one pass: level (the key's name, or overall), name, measures."""
    rows = log.select("*", F.explode(F.array(F.struct(F.lit("overall").alias("level"), F.lit("all").alias("name")), *(F.struct(F.lit(k).alias("level"), F.coalesce(F.col(k).cast("string"), F.lit(UNKNOWN)).alias("name")) for k in keys))).alias("__s"))
    return rows.groupBy("__s.level", "__s.name").agg(*usage_bucket())


def cache_counts(hit: Column, miss: Column, prompt: Column) -> tuple[Column, Column]:
    """Hits and misses; missing misses are what hits leave of the prompt, and nothing known is (0, 0)."""
    return F.coalesce(hit, F.lit(0)), F.coalesce(miss, F.when(hit.isNotNull(), F.greatest(F.lit(0), prompt - hit)), F.lit(0))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row for each key by `order` (its columns together unique): one aggregation, combined on the map side."""
    kept = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in kept if c not in order))).alias("__last"))
    return found.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in kept))


def score_summary(rows: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """For each key: rows, scored rows, mean score (2 places), the best row's name (highest score, then smallest name)."""
    best = F.min(F.when(F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))))
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count(score).alias("n_scored"), F.round(F.avg(score), 2).alias("mean_score"), best.getField("n").alias("best"))


def feedback_stats(rows: DataFrame, kind: str, similarity: str) -> DataFrame:
    """For each kind: rows, mean similarity (missing: 1), share changed."""
    mean = F.avg(F.coalesce(similarity, F.lit(1.0)))
    return rows.groupBy(kind).agg(F.count("*").alias("n"), mean.alias("mean_similarity"), (1 - mean).alias("change_ratio"))


def pair_counts(rows: DataFrame, group: str, item: str) -> DataFrame:
    """a < b and the number of groups that hold both. A group's pairs are made inside its row: groups must be bounded."""
    sets = rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.transform(F.slice("s", i + 1, F.size("s")), lambda b: F.struct(F.element_at("s", i).alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def appearances(rows: DataFrame, names: DataFrame, name: str, at: str) -> DataFrame:
    """Each name with the number of rows it is in and the last place, 0 and null for names in none."""
    seen = rows.select(F.trim(name).alias(name), at).groupBy(name).agg(F.count("*").alias("n"), F.max(at).alias("last_seen"))
    return names.join(seen, name, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def size_buckets(size: Column, edges: list[tuple[int, str]], over: str) -> Column:
    """The label of the first edge above size."""
    out = None
    for edge, label in edges:
        out = F.when(size < edge, label) if out is None else out.when(size < edge, label)
    return out.otherwise(over)


def index_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each key: n, least, most, and the smallest value that at least a share of the values are not above; exactly.

    Values are counted first, so what a key's window orders is its different values, not its rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__c"))
    up_to = Window.partitionBy(key).orderBy(value)
    places = counts.withColumns({"__up": F.sum("__c").over(up_to.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(Window.partitionBy(key))})
    exact = [F.min(F.when(F.col("__up") >= F.ceil(F.col("__n") * F.lit(share) - 1e-9), F.col(value))).alias(name) for name, share in shares.items()]
    found = places.groupBy(key).agg(F.sum("__c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *exact)
    alone = rows.groupBy(key).agg(F.count(value).alias("__all")).where("__all = 0").select(key, F.col("__all").alias("n"))
    return found.unionByName(alone, allowMissingColumns=True)


def majority_tags(rows: DataFrame, key: str, member: str, tag: str, one_in: int = 2) -> DataFrame:
    """Tags that at least one in `one_in` of a key's members have."""
    members = rows.groupBy(key).agg(F.count_distinct(member).alias("members"))
    counts = rows.groupBy(key, tag).agg(F.count_distinct(member).alias("n"))
    return counts.join(members, key).where(F.col("n") * one_in >= F.col("members")).select(key, tag, "n")


def snap(value: Column, anchors: list[int]) -> Column:
    """The nearest anchor; of two equally near ones, that of the smaller magnitude."""
    return F.array_min(F.array(*(F.struct(F.abs(value - a).alias("d"), F.lit(abs(a)).alias("m"), F.lit(a).alias("a")) for a in anchors))).getField("a")


def calibrated(scores: DataFrame, slot: str, positive: Column, score: str, top: int = 3) -> DataFrame:
    """For each slot: the range of its positives' and the others' scores, the mean of its best `top`, and a threshold.

    The threshold is half way between the lowest positive and the highest other score, if these are apart, and else 0.9
    of the lowest positive; null without positives.
    """
    yes, no = F.when(positive, F.col(score)), F.when(~positive, F.col(score))
    by = scores.groupBy(slot).agg(F.min(yes).alias("pos_min"), F.max(yes).alias("pos_max"), F.min(no).alias("neg_min"), F.max(no).alias("neg_max"))
    best = windows.top(scores, [slot], [F.col(score).desc()], top).groupBy(slot).agg(F.avg(score).alias("best"))
    apart = F.col("pos_min") > F.coalesce("neg_max", F.lit(float("-inf")))
    limit = F.when(apart & F.col("neg_max").isNotNull(), (F.col("pos_min") + F.col("neg_max")) / 2).otherwise(F.col("pos_min") * 0.9)
    return by.join(best, slot).withColumn("threshold", limit)


def term_hits(texts: DataFrame, text: str, terms: list[str], group: str) -> DataFrame:
    """group, term, rows that have it (document frequency) and how often it is there (without overlaps)."""
    n = lambda t: F.regexp_count(text, F.lit(re.escape(t)))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), n(t).alias("n")) for t in terms)))
    return texts.select(group, each.alias("x")).where("x.n > 0").groupBy(group, "x.term").agg(F.count("*").alias("in_rows"), F.sum(F.col("x.n").cast("long")).alias("hits"))


def together(texts: DataFrame, text: str, terms: list[str], group: str) -> DataFrame:
    """group, a, b (a < b), rows that have both terms."""
    own = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in sorted(terms))))
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, len(terms)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return texts.select(group, own.alias("own")).where(F.size("own") > 1).select(group, F.explode(pairs).alias("p")).groupBy(group, "p.a", "p.b").agg(F.count("*").alias("in_rows"))


def core_symbols(rows: DataFrame, keys: list[str], symbol: str, top: int) -> DataFrame:
    """A key's symbols that occur more than once, the `top` most frequent (of equal ones the first by name), with n."""
    counts = rows.groupBy(*keys, symbol).agg(F.count("*").alias("n")).where("n > 1")
    return windows.top(counts, keys, [F.col("n").desc(), F.col(symbol)], top).drop("rank")
