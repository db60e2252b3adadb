"""One-hop operators on typed edge tables (a, b, kind, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: node, other and the other columns."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    there = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *rest)
    return there.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), *rest))


def expand(seeds: DataFrame, edges: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The best neighbours of each seed (node): for each kind, up to its cap, by the strongest edge, then the id."""
    near = undirected(edges).join(seeds.select("node").distinct(), "node")
    best = near.groupBy("node", "kind", "other").agg(F.max("weight").alias("weight"))
    cap = F.element_at(F.create_map(*(x for k, n in caps.items() for x in (F.lit(k), F.lit(n)))), F.col("kind"))
    order = Window.partitionBy("node", "kind").orderBy(F.col("weight").desc(), "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.coalesce(cap, F.lit(0)))


def touching(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """The first `most` edges that touch a seed, by falling weight (missing: 50), then ids."""
    keys = seeds.select("node").distinct()
    ends = edges.join(keys, edges.a == keys.node, "left_semi").unionByName(edges.join(keys, edges.b == keys.node, "left_semi")).distinct()
    return ends.withColumn("weight", F.coalesce("weight", F.lit(50))).orderBy(F.col("weight").desc(), "a", "b", "kind").limit(most)


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    keys = nodes.select("node").distinct()
    return edges.join(keys, edges.a == keys.node, "left_anti").join(keys, edges.b == keys.node, "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy("node", "kind").agg(F.count_distinct("other").alias("degree"), F.max("weight").alias("strongest"))


def rebuilt(edges: DataFrame, groups: DataFrame, kind: str) -> DataFrame:
    """Edges (a, b, kind) with all of this kind that begin at a group replaced by those to its members.

    groups: node, members (array); nulls, repeats and the node itself make no edge.
    """
    kept = edges.join(groups.select(F.col("node").alias("a"), F.lit(kind).alias("kind")).distinct(), ["a", "kind"], "left_anti")
    made = groups.select(F.col("node").alias("a"), F.explode("members").alias("b")).where("b is not null and a <> b").distinct()
    return kept.select("a", "b", "kind").unionByName(made.select("a", "b", F.lit(kind).alias("kind")))


def owner_edges(found: DataFrame, present: DataFrame, roster: DataFrame, place: str, kind: str) -> DataFrame:
    """Edges (a, b, kind) from an owner's id to a thing that was found (place, thing, owner) in a place.

    An owner must be among those present there (place, name), unless nobody is noted for that place, and must be a name on
    the roster (name, id; of several the smallest id): others make no edge. Repeats are one edge.
    """
    noted = present.select(place).distinct().withColumn("__noted", F.lit(True))
    there = present.select(place, F.col("name").alias("owner")).distinct().withColumn("__there", F.lit(True))
    known = roster.groupBy(F.col("name").alias("owner")).agg(F.min("id").alias("a"))
    rows = found.select(place, F.col("thing").alias("b"), F.trim("owner").alias("owner")).join(noted, place, "left").join(there, [place, "owner"], "left")
    return rows.where("__noted is null or __there").join(known, "owner").select("a", "b", F.lit(kind).alias("kind")).distinct()


def from_references(edges: DataFrame, references: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """edges (a, b, kind) with those that other tables' references (a, b) make, by kind, and kind, made, skipped: new edges, and
    rows without one of the ends. Edges that are there already, and repeats, are not made again, so a second run makes none."""
    rows = None
    for kind, table in references.items():
        own = table.select("a", "b", F.lit(kind).alias("kind"))
        rows = own if rows is None else rows.unionByName(own)
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    new = rows.where(whole).distinct().join(edges.select("a", "b", "kind").distinct(), ["a", "b", "kind"], "left_anti").select("a", "b", "kind")
    counts = rows.groupBy("kind").agg(F.count_if(~whole).alias("skipped")).join(new.groupBy("kind").agg(F.count("*").alias("made")), "kind", "left")
    return edges.select("a", "b", "kind").unionByName(new), counts.select("kind", F.coalesce("made", F.lit(0)).alias("made"), "skipped")


def injection(seeds: DataFrame, edges: DataFrame, names: DataFrame, caps: dict[str, int], most: int = 40) -> DataFrame:
    """node, block: a text on each seed (node) with a line for each kind of edge, its best neighbours' names, `most` in all.

    names: node, name, dead (boolean); the dead are named in a line of their own. Kinds are in the order of caps.
    """
    near = expand(seeds, edges, caps).withColumn("__n", F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "kind", "other"))).where(F.col("__n") <= most)
    told = near.join(names.select(F.col("node").alias("other"), "name", F.coalesce("dead", F.lit(False)).alias("dead")), "other")
    title = F.when(F.col("dead"), "†").otherwise(F.col("kind"))
    place = F.when(F.col("dead"), len(caps)).otherwise(F.element_at(F.create_map(*(x for i, k in enumerate(caps) for x in (F.lit(k), F.lit(i)))), F.col("kind")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "name"))), lambda x: x["name"]), ", ")
    lines = told.groupBy("node", title.alias("title"), place.alias("place")).agg(listed.alias("names"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("title", F.lit(": "), "names").alias("line")))), lambda x: x["line"]), "\n")
    return lines.groupBy("node").agg(text.alias("block"))
