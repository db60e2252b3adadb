"""What happened while somebody was away: events of several sources behind the last sight of an entity, with quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_behind(entities: DataFrame, events: DataFrame, key: str, last: str, at: list[str], most: int) -> DataFrame:
    """key, rank (from 1) and the columns of events: each entity's first `most` events along `at` whose first column is
    beyond the entity's `last` (all of them where it is null). Only `most` rows a key leave each task."""
    both = events.join(entities.select(key, F.col(last).alias("__last")), key)
    open_ = both.where(F.col("__last").isNull() | (F.col(at[0]) > F.col("__last"))).drop("__last")
    return open_.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*at))).where(F.col("rank") <= most)


def group_digest(entities: DataFrame, events: DataFrame, key: str, group: str, last: str, at: list[str], most: int) -> DataFrame:
    """key, rank and the columns of events: the first `most` events of an entity's whole group beyond its `last`.

    Entities and events are counted along `at` once, so an entity knows the number of its group's first event behind it,
    and takes that one and the next by equal numbers: no pairs of entities and events. A group's events are ordered in
    one task: groups are projects.
    """
    ranks = events.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*at)))
    # how many of the group's events are at or before `last`: events first, entities behind those of the same moment
    moments = ranks.select(group, F.col(at[0]).alias("__at"), F.lit(0).alias("__kind"), "__n", F.lit(None).cast(dict(entities.dtypes)[key]).alias(key))
    asked = entities.select(group, F.col(last).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("int").alias("__n"), key)
    seen = F.max("__n").over(Window.partitionBy(group).orderBy(F.col("__at").asc_nulls_first(), "__kind").rowsBetween(Window.unboundedPreceding, 0))
    begins = moments.unionByName(asked).withColumn("__seen", F.coalesce(seen, F.lit(0))).where("__kind = 1")
    wanted = begins.select(key, group, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("rank"), "__seen").withColumn("__n", F.col("__seen") + F.col("rank"))
    return wanted.join(ranks, [group, "__n"]).drop("__seen", "__n", group)


def material(entities: DataFrame, sources: dict[str, DataFrame], key: str, item: str) -> DataFrame:
    """Entities with an array of each source's items (key, rank, item) in rank order, empty without any, and `priority`, the
    first source by order that has some, or fallback."""
    out = entities
    for name, rows in sources.items():
        lists = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("x")))), lambda r: r["x"])
        out = out.join(rows.groupBy(key).agg(lists.alias(name)), key, "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(f"array<{dict(rows.dtypes)[item]}>")))
    found = reduce(lambda w, n: w.when(F.size(n) > 0, n), list(sources)[1:], F.when(F.size(next(iter(sources))) > 0, next(iter(sources))))
    return out.withColumn("priority", found.otherwise("fallback"))
