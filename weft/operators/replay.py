"""Append-only logs with before-images: applied, undone to any place, compared with what is there; drift of approved plans.

A log has seq (its order), the key of the row that an entry changed, and the images `before` and `after`, structs of the
row's other columns: no before for a row that was made, no after for one that was removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def applied(base: DataFrame, log: DataFrame, key: str, upto: int | None = None) -> DataFrame:
    """The table after the log's entries up to and with seq `upto` (all for None): the last image of each key."""
    entries = log if upto is None else log.where(F.col("seq") <= upto)
    last = entries.groupBy(key).agg(F.max(F.struct("seq", "after")).getField("after").alias("__after"))
    kept = base.join(last, key, "left_anti")
    return kept.unionByName(last.where("__after is not null").select(key, "__after.*").select(*base.columns))


def undone(current: DataFrame, log: DataFrame, key: str, upto: int) -> DataFrame:
    """Every row of the table, or that the log brings back, with `state`, as it was after entry `upto`.

    state: kept (no later entry), restored (to the first later before-image), removed (made later; its columns are what it
    has), conflict (it is not what the last later entry left, so someone else changed, made or removed it: what is there
    stays; null columns if nothing is). Rows with state kept, restored or conflict that are there make up the table: see
    table_of. One aggregate of the log and one join by key.
    """
    columns = [c for c in current.columns if c != key]
    image = F.struct(*columns)
    later = log.where(F.col("seq") > upto).groupBy(key).agg(F.min(F.struct("seq", "before")).getField("before").alias("__before"), F.max(F.struct("seq", "after")).getField("after").alias("__after"), F.lit(True).alias("__later"))
    both = current.select(key, image.alias("__now")).join(later, key, "full")
    state = F.when(F.col("__later").isNull(), "kept").when(~F.col("__now").eqNullSafe(F.col("__after").cast(current.select(image.alias("x")).schema["x"].dataType)), "conflict").when(F.col("__before").isNull(), "removed").otherwise("restored")
    placed = both.withColumn("state", state)
    return placed.select(key, *(F.when(F.col("state") == "restored", F.col(f"__before.{c}")).otherwise(F.col(f"__now.{c}")).alias(c) for c in columns), (F.col("__now").isNotNull() | (F.col("state") == "restored")).alias("there"), "state")


def table_of(rows: DataFrame) -> DataFrame:
    """The table that undone() comes to."""
    return rows.where("there and state <> 'removed'").drop("there", "state")


def drift(approved: DataFrame, recomputed: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys, state of every approved or newly found action: ready (both, on the same text), changed (both, but the text's
    digest is not that of the approval), unapproved (found now only), settled (approved, and not needed any more)."""
    sides = [df.select(*keys, F.col(digest).alias(name)) for df, name in ((approved, "__a"), (recomputed, "__b"))]
    both = sides[0].withColumn("__x", F.lit(1)).join(sides[1].withColumn("__y", F.lit(1)), keys, "full")
    state = F.when(F.col("__x").isNull(), "unapproved").when(F.col("__y").isNull(), "settled").when(F.col("__a").eqNullSafe(F.col("__b")), "ready").otherwise("changed")
    return both.select(*keys, state.alias("state"))
