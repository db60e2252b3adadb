"""Joins: look-ups in order, first match of several tables, anti-joins, intervals, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import dictionary


def lookup(requests: DataFrame, key: str, tables: list[DataFrame], values: list[str]) -> DataFrame:
    """Each request with the values of the first table that has its key, and `found_in` (from 0); others are left out."""
    out, hits = requests, []
    for i, table in enumerate(tables):
        marked = table.select(key, F.struct(*values).alias(f"__v{i}"))
        out, hits = out.join(marked, key, "left"), [*hits, f"__v{i}"]
    found = F.coalesce(*(F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits)))
    return out.withColumn("found_in", found).withColumn("__v", F.coalesce(*hits)).where("found_in is not null").select(*requests.columns, "__v.*", "found_in")


def best_overlap(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """For each left interval (id, lo, hi) the right one (rid, rlo, rhi) of the same key that overlaps it most.

    Intervals are dealt to buckets of `width` places, so only neighbours meet; a pair that shares several buckets is
    tested once, in the first. Ties go to the smaller rid. Left intervals without any are left out.
    """
    cells = lambda df, lo, hi: df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    pairs = cells(left, "lo", "hi").join(cells(right, "rlo", "rhi"), [key, "__cell"])
    pairs = pairs.where((F.col("lo") <= F.col("rhi")) & (F.col("rlo") <= F.col("hi")) & (F.col("__cell") == F.floor(F.greatest("lo", "rlo") / width)))
    size = F.least("hi", "rhi") - F.greatest("lo", "rlo") + 1
    best = pairs.groupBy("id").agg(F.max(F.struct(size.alias("size"), (-F.col("rid")).alias("r"))).alias("b"))
    return best.select("id", (-F.col("b.r")).alias("rid"), F.col("b.size").alias("overlap"))


def absent(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a row of right."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def spread(rows: DataFrame, one: DataFrame, keys: list[str], by: str, how: str = "left", ways: int = 16) -> DataFrame:
    """rows joined with `one`, which has at most a row for each key, so that a frequent key is in `ways` tasks, not one.

    Rows are dealt by a hash of their column `by`, and `one` is repeated `ways` times: pass keys that do repeat only.
    """
    dealt = rows.withColumn("__way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    every = one.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(every, [*keys, "__way"], how).drop("__way")


def both_known(edges: DataFrame, members: DataFrame, group: str, ends: tuple[str, str], name: str) -> DataFrame:
    """Edges whose two ends are members of the edge's group, without self-edges and repeats."""
    out = edges.where(F.col(ends[0]) != F.col(ends[1]))
    for end in ends:
        out = out.join(members.select(group, F.col(name).alias(end)).distinct(), [group, end], "left_semi")
    return out.dropDuplicates([group, *ends]).select(*edges.columns)


def stacked(tables: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    """Rows of several tables with the table's name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn(kind, F.lit(k)) for k, t in tables.items()))


def tagged(rows: DataFrame, tags: Column, wanted: list[str]) -> DataFrame:
    """Rows with one of the wanted tags, in any case; no wanted tags pass all."""
    lower = [t.lower() for t in wanted if t.strip()]
    return rows.where(F.arrays_overlap(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower), F.array(*map(F.lit, lower)))) if lower else rows


def resolved(names: DataFrame, tables: dict[str, DataFrame], end: int = 3, least: int = 5) -> DataFrame:
    """name, kind, id, exact: the rows (name, id) of the tables that names (name) mean.

    A name means all rows of that very name. One without any means those of at least `least` characters whose last
    `end` characters are its last ones. Both are equi-joins. Repeated names are asked once.
    """
    known = stacked({k: t.select("name", "id") for k, t in tables.items()})
    asked = names.select("name").where("name is not null").distinct()
    same = asked.join(known, "name").select("name", "kind", "id", F.lit(True).alias("exact"))
    ending = lambda df: df.where(F.length("name") >= least).withColumn("__end", F.right("name", F.lit(end)))
    open_ = ending(asked.join(known.select("name").distinct(), "name", "left_anti"))
    alike = open_.join(ending(known).withColumnRenamed("name", "__of"), "__end").select("name", "kind", "id", F.lit(False).alias("exact"))
    return same.unionByName(alike)


def first_of(rows: DataFrame, known: DataFrame, key: str, ways: list[list[str]]) -> DataFrame:
    """Adds `found` (the known row's smallest `key`) and way (from 0): by the first of the ways, lists of equal columns,
    that finds one; both null where none does. Nulls in these columns find nothing."""
    out = rows
    for i, columns in enumerate(ways):
        best = known.dropna(subset=columns).groupBy(*columns).agg(F.min(key).alias(f"__f{i}"))
        out = out.join(best, columns, "left")
    found = [F.col(f"__f{i}") for i in range(len(ways))]
    way = F.coalesce(*(F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(found)))
    return out.select(*rows.columns, F.coalesce(*found).alias("found"), way.alias("way"))


def paired(left: DataFrame, right: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Rows of both tables of a key, the n-th with the n-th: key, n, left_name, right_name, agrees; what one table lacks
    is null and does not agree."""
    numbered = lambda df, to: df.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("n"), F.col(name).alias(to))
    both = numbered(left, f"left_{name}").join(numbered(right, f"right_{name}"), [key, "n"], "full")
    return both.withColumn("agrees", F.coalesce(F.col(f"left_{name}") == F.col(f"right_{name}"), F.lit(False)))


def alias_decisions(aliases: DataFrame, roster: DataFrame) -> DataFrame:
    """alias, owner, decision: merge for an alias with one owner that is no roster name, propose for one that is on the
    roster, conflict for one with several owners (owner is then the first by name)."""
    by = aliases.groupBy("alias").agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("n"))
    known = roster.select(F.col("name").alias("alias"), F.lit(True).alias("known")).distinct()
    decision = F.when(F.col("n") > 1, "conflict").when(F.col("known"), "propose").otherwise("merge")
    return by.join(known, "alias", "left").select("alias", "owner", decision.alias("decision"))


def living(lists: DataFrame, members: str, states: DataFrame, dead: list[str], noted: list[str], key: str) -> DataFrame:
    """key, members without those whose state (states: member, state) is a dead one, and notes: those with a noted state.

    Members without a state stay. Order is kept; a null list is an empty one; a key has one row.
    """
    each = lists.select(key, F.posexplode(members).alias("at", "member")).join(states.select("member", "state"), "member", "left")
    kept = each.where(~F.coalesce(F.col("state").isin(*dead), F.lit(False)))
    ordered = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", "member")))), lambda x: x["member"])
    by = kept.groupBy(key).agg(ordered(F.lit(True)).alias("kept"), ordered(F.col("state").isin(*noted)).alias("notes"))
    empty = F.array().cast(dict(lists.dtypes)[members])
    return lists.select(key).join(by, key, "left").select(key, F.coalesce("kept", empty).alias(members), F.coalesce("notes", empty).alias("notes"))


def unmistakable(names: DataFrame) -> DataFrame:
    """name: those of names that no other one contains, and that contain no other one. Repeated names are one."""
    own = names.select("name").where("name is not null").distinct()
    met = dictionary.contained(own.withColumnRenamed("name", "text"), own.withColumnRenamed("name", "phrase")).where("text <> phrase")
    return own.join(met.select(F.explode(F.array("text", "phrase")).alias("name")).distinct(), "name", "left_anti")
