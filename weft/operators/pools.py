"""Shared pools of entries (id, name, aliases, category, genre, status, reference_only): what may be seen, looked up, offered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(rows: DataFrame, genres: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Active entries that aren't for reference only, of one of the genres and of the category, where these are named."""
    out = rows.where((F.col("status") == "active") & ~F.coalesce("reference_only", F.lit(False)))
    out = out.where(F.col("genre").isin(*genres)) if genres else out
    return out.where(F.col("category") == category) if category else out


def offered(rows: DataFrame, by: str, per_category: int) -> DataFrame:
    """by, category, names (array): the first `per_category` distinct names of each category, for each value of `by`."""
    once = rows.select(by, "category", "name").where("name is not null").distinct()
    first = once.withColumn("__r", F.row_number().over(Window.partitionBy(by, "category").orderBy("name"))).where(F.col("__r") <= per_category)
    return first.groupBy(by, "category").agg(F.array_sort(F.collect_list("name")).alias("names"))


def injection_block(lists: DataFrame, by: str, title: str) -> DataFrame:
    """by, block: the lists of offered() as one text, a line for each category."""
    line = F.concat("category", F.lit(": "), F.array_join("names", ", "))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("category", line.alias("line")))), lambda x: x["line"])
    return lists.groupBy(by).agg(F.array_join(F.concat(F.array(F.lit(title)), lines), "\n").alias("block"))


def looked_up(names: DataFrame, pools: dict[str, DataFrame]) -> DataFrame:
    """name, kind, id of each distinct name that an active entry has: pools in their order, in a pool a name before an alias, and
    of several entries the smallest id. Blanks around names don't count; others are left out. Two equi-joins a pool."""
    asked = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    known = []
    for i, (kind, rows) in enumerate(pools.items()):
        active = rows.where("status = 'active'")
        by_name = active.select("name", F.lit(2 * i).alias("__way"), F.lit(kind).alias("kind"), "id")
        known += [by_name, active.select(F.explode("aliases").alias("name"), F.lit(2 * i + 1).alias("__way"), F.lit(kind).alias("kind"), "id")]
    best = reduce(DataFrame.unionByName, known).groupBy("name").agg(F.min(F.struct("__way", "id", "kind")).alias("__b"))
    return asked.join(best, "name").select("name", "__b.kind", "__b.id")


def pool_stats(pools: dict[str, DataFrame]) -> DataFrame:
    """kind, n, active, reference_only of each pool."""
    counts = [rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.count_if("reference_only").alias("reference_only")).select(F.lit(kind).alias("kind"), "*") for kind, rows in pools.items()]
    return reduce(DataFrame.unionByName, counts)


def sampled(rows: DataFrame, keys: list[str], of: str, most: int, seed: int = 0) -> DataFrame:
    """For each of the keys `most` rows at random: the first by a hash of `of` and the seed, the same in every run."""
    order = F.md5(F.concat_ws("-", F.lit(seed), of))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, of))).where(F.col("__r") <= most).drop("__r")


def vocabulary(rows: DataFrame, group: str, word: str) -> DataFrame:
    """group, words: its distinct words that aren't blank, in order; a group without any has none. Blank groups are left out."""
    clean = rows.select(F.trim(group).alias(group), F.nullif(F.trim(F.coalesce(word, F.lit(""))), F.lit("")).alias("__w")).where(F.col(group) != "").distinct()
    return clean.groupBy(group).agg(F.array_sort(F.collect_list("__w")).alias("words"))


def catalogued(rows: DataFrame, group: str, name: str, locked: str, most: int) -> DataFrame:
    """group, rank and the columns of rows: a group's entries for a reader to choose from, locked ones first, then by name."""
    order = Window.partitionBy(group).orderBy(F.coalesce(locked, F.lit(False)).desc(), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
