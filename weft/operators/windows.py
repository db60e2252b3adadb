"""Ordered operators: runs, stitched presence, tiers, ranks within categories, look-behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], at: str, gap: int = 1) -> DataFrame:
    """Maximal runs of places at most `gap` apart: keys, run (from 1), first, last, n. Repeated places count once."""
    by = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(by) > gap).cast("int"), F.lit(1))
    marked = rows.select(*keys, at).distinct().withColumn("__new", new).withColumn("run", F.sum("__new").over(by))
    return marked.groupBy(*keys, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def clusters(segments: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Segments (first, last) whose free space is at most `gap`: keys, cluster, first, last, segments, n."""
    by = Window.partitionBy(*keys).orderBy("first")
    new = F.coalesce((F.col("first") - F.lag("last").over(by) > gap).cast("int"), F.lit(1))
    marked = segments.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(by))
    return marked.groupBy(*keys, "cluster").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("segments"), F.sum("n").alias("n"))


def presence_grade(total: Column, places: Column, segments: Column, groups: Column, edges: tuple[int, int, int, int] = (5, 10, 40, 100), share: float = 0.4) -> Column:
    """0 to 5 by total presence, its share of all places, long segments and their clusters."""
    t0, t1, t2, t3 = edges
    return F.when(total < t0, 0).when(total < t1, 1).when((total >= t3) & (total >= places * share) & (groups >= 1), 5).when((total >= t2) & (segments >= 2), 4).when((total >= t2) | (segments >= 1), 3).otherwise(2)


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], symbol: str) -> DataFrame:
    """Run-length encoding of symbols along an order: keys, run (from 1), symbol, n."""
    by = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((~F.col(symbol).eqNullSafe(F.lag(symbol).over(by))).cast("int"), F.lit(1))
    first = F.row_number().over(by) == 1
    marked = rows.withColumn("__c", F.when(first, 1).otherwise(change)).withColumn("run", F.sum("__c").over(by))
    return marked.groupBy(*keys, "run").agg(F.first(symbol).alias(symbol), F.count("*").alias("n"))


def dispatch(rows: DataFrame, category: str, priority: str, name: str, exclusive: Column) -> DataFrame:
    """Adds active and winner: in an exclusive category only the highest priority (then the first name) is active.

    A category's winner is an aggregate that is joined back, so no category is sorted in one task. Names tell the rows
    of a category apart; priorities are numbers.
    """
    best = rows.groupBy(F.col(category).alias("__of")).agg(F.min(F.struct((-F.col(priority)).alias("p"), F.col(name).alias("n"))).getField("n").alias("__best"))
    both = rows.join(best, rows[category].eqNullSafe(best["__of"])).drop("__of")
    both = both.withColumn("active", ~exclusive | (F.col(name) == F.col("__best")))
    return both.withColumn("winner", F.when(~F.col("active"), F.col("__best"))).drop("__best")


def running(rows: DataFrame, keys: list[str], at: str, size: Column, out: str, width: int = 10_000) -> DataFrame:
    """Adds the sum of `size` (a number) over a key's rows up to and with each row, along `at`, a number that tells a
    key's rows apart.

    Rows are summed within ranges of `width` numbers, from what all ranges before hold: a key's rows are in no single
    task, only a row for each of its ranges.
    """
    cut = rows.withColumns({"__key": F.struct(*keys), "__range": F.floor(F.col(at) / width), "__size": size})
    held = cut.groupBy("__key", "__range").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("__key", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    by = Window.partitionBy("__key", "__range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn("__in", F.sum("__size").over(by))
    return inner.join(base, ["__key", "__range"]).withColumn(out, F.col("__before") + F.col("__in")).drop("__key", "__range", "__size", "__before", "__in")


def numbered(rows: DataFrame, keys: list[str], at: str, out: str, width: int = 10_000) -> DataFrame:
    """Adds the number (from 1) of each row of a key along `at`; see running."""
    return running(rows, keys, at, F.lit(1).cast("long"), out, width)


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key by order, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def changes(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Rows that differ from the row before in one of fields, and which; empty, zero and null are alike. First rows count."""
    by = Window.partitionBy(*keys).orderBy(*order)
    blank = lambda c: F.nullif(F.nullif(c.cast("string"), F.lit("")), F.lit("0"))
    changed = F.array_compact(F.array(*(F.when(~blank(F.col(c)).eqNullSafe(blank(F.lag(c).over(by))), F.lit(c)) for c in fields)))
    return rows.withColumn("changed", changed).where(F.size("changed") > 0)


def previous(rows: DataFrame, keys: list[str], at: str, value: str, before: Column) -> DataFrame:
    """The latest value before a place, for each key: one aggregation without a sort."""
    return rows.where(F.col(at) < before).groupBy(*keys).agg(F.max(at).alias("at"), F.max_by(value, at).alias(value))


def first_uncovered(rows: DataFrame, covered: DataFrame, key: str, at: str, every: int) -> DataFrame:
    """The first `every` places after the last covered one: key, first, last; none where there are fewer."""
    last = covered.groupBy(key).agg(F.max("last").alias("__covered"))
    open_ = rows.join(last, key, "left").where(F.col(at) > F.coalesce("__covered", F.lit(0)))
    return top(open_, [key], [F.col(at)], every).groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where(F.col("n") == every).drop("n")


def quarters(position: Column, n: Column) -> Column:
    """1 to 4: the quarter of n places that position (from 0) is in."""
    return F.least(F.floor(position * 4 / n) + 1, F.lit(4)).cast("int")


def trailing(rows: DataFrame, keys: list[str], at: str, seconds: int, size: str, out: str) -> DataFrame:
    """Adds the sum of `size` over a key's rows of the last `seconds` up to and with each row (a timestamp column `at`)."""
    by = ", ".join(f"`{k}`" for k in keys)
    return rows.withColumn(out, F.expr(f"sum(`{size}`) OVER (PARTITION BY {by} ORDER BY `{at}` RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"))


def every_nth(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """A systematic sample: of a key's n rows in order, the first and each (n // most)th behind it, `most` at most."""
    by = Window.partitionBy(*keys)
    step = F.greatest(F.floor(F.count("*").over(by) / most), F.lit(1))
    placed = rows.withColumns({"__at": F.row_number().over(by.orderBy(*order)) - 1, "__step": step})
    return placed.where((F.col("__at") % F.col("__step") == 0) & (F.col("__at") < F.col("__step") * most)).drop("__at", "__step")
