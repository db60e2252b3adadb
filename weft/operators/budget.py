"""Context budgets: which blocks of text fit, by priority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import windows


def plan(blocks: DataFrame, key: str, budget: int, least: int = 200) -> DataFrame:
    """Adds taken (characters) and decision (kept, cut, dropped) to blocks (name, size, required, priority).

    Required blocks first, then by falling priority and name: each is kept if it fits, else cut to what is left if
    that is at least `least`, else dropped. Keys must fit a task.
    """

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["required", "priority", "name"], ascending=[False, False, True])
        left, taken, decision = budget, [], []
        for size in frame["size"]:
            n = size if size <= left else left if left >= least else 0
            taken.append(n)
            decision.append("kept" if n == size else "cut" if n else "dropped")
            left -= n
        return frame.assign(taken=taken, decision=decision)

    return blocks.groupBy(key).applyInPandas(step, blocks.select("*", F.lit(0).cast("long").alias("taken"), F.lit("").alias("decision")).schema)


def within(rows: DataFrame, keys: list[str], at: str, size: str, budget: int) -> DataFrame:
    """Rows along `at` (a number, unique for a key) as long as their sizes sum up to no more than the budget; adds used."""
    return windows.running(rows, keys, at, F.col(size), "used").where(F.col("used") <= budget)


def evicted(rows: DataFrame, key: str, group: str, at: str, size: str, budget: int) -> DataFrame:
    """Adds evicted: while a key's sizes sum up to more than the budget, its largest group (of equal ones the first) loses
    its last row along `at`; nothing more is lost once that group has a single row.

    A group's size only falls, so the rows go in the order of what their groups hold when they go, which is the sum of
    the sizes up to each: no loop, two windows. Sizes are not negative; `at` tells a group's rows apart. A key is one
    request with its references: few rows.
    """
    by_group = Window.partitionBy(key, group).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumns({"__level": F.sum(size).over(by_group), "__last": F.row_number().over(Window.partitionBy(key, group).orderBy(at)) == 1})
    order = Window.partitionBy(key).orderBy(F.col("__level").desc(), group, F.col(at).desc())
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.sum(size).over(Window.partitionBy(key)) - before > budget
    ends = F.max("__last").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("evicted", over & ~ends).drop("__level", "__last")
