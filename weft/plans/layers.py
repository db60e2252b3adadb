"""Prompts of several layers: quotas by relevance within a layer, one budget over all of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import budget


@dataclass(frozen=True)
class Layer:
    """rows: the request's key, must (boolean), relevance (number), place (unique for a request), line.

    All lines with must are taken, `most` others that are relevant (by falling relevance, then place), or, where none is,
    the first `fallback` by place. A higher priority gets its share of the budget first; `order` is the layer's place.
    """

    name: str
    title: str
    rows: DataFrame
    priority: int
    order: int
    most: int = 15
    fallback: int = 3


def chosen(layer: Layer, key: str) -> DataFrame:
    """key and the lines that the layer takes, with rank, their order: must first, then by relevance and place.

    A request's other lines are ranked twice by windows of which no task keeps more than the quota.
    """
    rows = layer.rows.select(key, F.coalesce("must", F.lit(False)).alias("must"), F.coalesce(F.col("relevance").cast("double"), F.lit(0.0)).alias("relevance"), "place", "line").where("line is not null and line <> ''")
    rest = rows.where("not must")
    relevant = rest.where("relevance > 0").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("relevance").desc(), "place"))).where(F.col("rank") <= layer.most)
    others = rest.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("rank") <= layer.fallback)
    others = others.join(relevant.select(key).distinct(), key, "left_anti")
    must = rows.where("must").withColumn("rank", F.lit(0))
    return must.unionByName(relevant).unionByName(others)


def block(layer: Layer, key: str) -> DataFrame:
    """key, name, title, content, size, required, priority, order: the layer's lines in one text; none for no lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "place", "line"))), lambda x: x["line"])
    text = F.concat(F.lit(layer.title), F.lit("\n"), F.array_join(lines, "\n"))
    out = chosen(layer, key).groupBy(key).agg(text.alias("content"))
    return out.select(key, F.lit(layer.name).alias("name"), "content", F.length("content").cast("long").alias("size"), F.lit(False).alias("required"), F.lit(layer.priority).alias("priority"), F.lit(layer.order).alias("order"))


def prompt(layers: list[Layer], key: str, characters: int, least: int = 100) -> DataFrame:
    """key, prompt, decisions (a map of layer to kept, cut or dropped) of every request with a line in some layer.

    The layers' texts share `characters` by priority (see budget.plan), are cut to what they got, and follow each other in
    their order with a blank line between.
    """
    blocks = reduce(DataFrame.unionByName, (block(x, key) for x in layers))
    planned = budget.plan(blocks, key, characters, least)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("taken") > 0, F.struct("order", F.substring("content", F.lit(1), F.col("taken").cast("int")).alias("text"))))), lambda x: x["text"])
    return planned.groupBy(key).agg(F.array_join(parts, "\n\n").alias("prompt"), F.map_from_entries(F.collect_list(F.struct("name", "decision"))).alias("decisions"))
