"""Casts: which of a book's known parts an arc uses, and traits of parts put in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from weft import storage
from weft.operators import dictionary


#: Rows of slots up to which they are sent to every task.
MOST_SLOTS = 100_000


def _whole(own: dictionary.Automaton, text: str) -> list[int]:
    """Numbers of the phrases that are in text without a digit behind them."""
    return [*{i for last, (i, _) in own.iter(text) if not "0" <= text[last + 1 : last + 2] <= "9"}] if len(own) else []


def _named(arcs: DataFrame, slots: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """arcs' book and arc with the slots of the book that the text names; no text is moved while the aliases can be sent."""
    words = dictionary.held(slots, "alias")
    if words is None:
        pairs = dictionary.contained(arcs.select("book", "arc", "text"), slots.select("alias").distinct(), "text", "alias")
        named = pairs.where(F.regexp("text", F.concat(F.lit(r"\Q"), "alias", F.lit(r"\E(?!\d)")))).select("book", "arc", "alias")
        return named.join(sent(slots), ["book", "alias"])
    numbers = arcs.sparkSession.createDataFrame([(p, i) for i, p in enumerate(words)], "alias string, __i int")
    hits = dictionary.scanner(arcs.sparkSession, words, _whole, ArrayType(IntegerType()))(F.col("text"))
    return arcs.select("book", "arc", F.explode(hits).alias("__i")).join(sent(slots.join(F.broadcast(numbers), "alias")), ["book", "__i"])


def arc_casts(arcs: DataFrame, slots: DataFrame, most: int = 8) -> DataFrame:
    """book, arc, alias, kind, rank: the parts (slots: book, alias, kind, first) of an arc's book (arcs: book, arc, text) that its text
    names, and the protagonists in any case; or the book's first parts where there is none of either. `most` at most, the
    protagonists first, then by first appearance and alias.

    An alias is not named by a longer one that goes on with a digit (`part 2` by `part 21`). Texts are read once for all
    aliases; a part comes to an arc by an equi-join of book and alias, and only an arc's best parts are shuffled and stored.
    """
    own = slots.select("book", "alias", "kind", "first").where("alias <> ''").distinct()
    sent = F.broadcast if own.count() <= MOST_SLOTS else lambda slots: slots
    lead = F.col("kind") == "protagonist"
    key, part = ["book", "arc"], ["alias", "kind", "first"]
    named = _named(arcs, own, sent).where(~F.coalesce(lead, F.lit(False))).select(*key, *part)
    leads = arcs.select(*key).join(sent(own.where(lead)), "book").select(*key, *part)
    # an arc's own row, behind all of its parts, is the first one where there are none
    none = arcs.select(*key, *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in part))
    order = [F.col("alias").isNull(), (~lead).cast("int"), F.col("first"), F.col("alias"), F.col("kind")]
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(*order))
    best = named.unionByName(leads).unionByName(none).withColumn("rank", rank).where(F.col("rank") <= most).distinct()
    best = storage.stored(best, "casts")
    opening = own.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.col("first"), "alias"))).where(F.col("rank") <= most)
    rest = best.where("alias is null and rank = 1").select(*key).join(sent(opening), "book")
    columns = [*key, "alias", "kind", "rank"]
    return best.where("alias is not null").select(*columns).unionByName(rest.select(*columns))


def settled_trait(value: Column, basis: Column, limit: int = 10, inferred: int = 4) -> Column:
    """A trait's value within ±limit, 0 for none; one beyond ±inferred that doesn't come from the text is ±1: what is only
    inferred may not be extreme."""
    v = F.when(value.isNull(), 0).otherwise(F.least(F.greatest(F.rint(value), F.lit(-limit)), F.lit(limit)).cast("int"))
    return F.when((F.coalesce(basis, F.lit("text")) != "text") & (F.abs(v) > inferred), F.signum(v).cast("int")).otherwise(v)


def settled_traits(rows: DataFrame, key: str, names: list[str], values: str, bases: str) -> DataFrame:
    """key, traits (a map of all names), clamped, inferred, missing: rows' maps of values and of where they come from, in order;
    how many were beyond the limit, only inferred but extreme, or not there. A null or empty map has no traits at all."""
    value, basis = (lambda n: F.try_element_at(F.col(values), F.lit(n))), (lambda n: F.try_element_at(F.col(bases), F.lit(n)))
    count = lambda test: sum((F.when(test(n), 1).otherwise(0) for n in names), F.lit(0))
    there = F.coalesce(F.size(values), F.lit(0)) > 0
    traits = F.create_map(*(x for n in names for x in (F.lit(n), settled_trait(value(n), basis(n)))))
    far = lambda n: (F.coalesce(basis(n), F.lit("text")) != "text") & (F.abs(F.rint(value(n))) > 4)
    return rows.select(
        key, F.when(there, traits).alias("traits"), F.when(there, count(lambda n: F.abs(value(n)) > 10)).otherwise(0).alias("clamped"),
        F.when(there, count(far)).otherwise(0).alias("inferred"),
        F.when(there, count(lambda n: value(n).isNull())).otherwise(0).alias("missing"),
    )
