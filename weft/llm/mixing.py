"""Mixing sources to target weights by a low-discrepancy schedule: DataFrame functions only.

Slot n of the schedule has the point frac(n * golden ratio); the point's place among the cumulative target shares
names the slot's source, so that every stretch of the schedule holds the sources in proportion. Each source's
documents are shuffled by a hash and laid end to end, and this stream is cut into blocks of equal words; the k-th
slot of a source takes its k-th block, and begins with the first again after the last. A source's last slot is
trimmed so that it takes its target to the word, and the few slots by which the sequence may fall short of a
source's need follow at the end.

Ranks of slots and places of documents are two-level prefix sums (see common.prefix_sum): a source with most of
the rows is never in one task. Only the table of sources, a row for each, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import common

#: Golden ratio's fraction times 2^31, made odd: n * GOLDEN mod 2^31 visits each of the 2^31 points once a round.
GOLDEN = 1327217885
ROUND = 1 << 31
#: Equal parts of [0, 1) that lead a point to the few sources near it.
CELLS = 1024
SLOTS_PER_CHUNK = 1 << 14


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`: white space runs become one blank; blanks then separate words."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: list[int], total: float, cap: float) -> DataFrame:
    """Adds weight, target and goal (the target in whole words) to sizes (source, source_size).

    Sources in order of code points, null last, weigh `weights` in turn and share `total` times all sizes. A target
    stops at `cap` times the source's size; what is over goes to the others by weight, until none is above. With
    sources by falling weight per cap, that is the level at which the first k are full and the rest are not.
    """
    last = [F.col("source").isNull(), F.col("source").cast("binary")]
    rank = F.row_number().over(Window.orderBy(*last))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("__full", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("__full") / F.col("weight"), *last)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(total)) - F.coalesce(F.sum("__full").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("__level", level)
    first = F.min(F.when(F.col("__level") * F.col("weight") <= F.col("__full"), F.struct((F.col("__full") / F.col("weight")).alias("at"), F.col("__level").alias("level")))).over(whole)
    target = F.coalesce(F.least(F.col("__full"), first.getField("level") * F.col("weight")), F.col("__full"))
    rows = rows.withColumn("target", target)
    return rows.withColumn("goal", F.least(F.floor(F.col("target") + 0.5), F.floor("__full")).cast("long")).drop("__full", "__level")


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """slot, source, rank (from 0 within the source), of every slot that sources (source, source_size, goal) need."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    over = F.col("goal") % F.col("source_size")
    need = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size")) * blocks + F.ceil(over / block_words)).otherwise(0).cast("long")
    up_to = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = sources.withColumn("need", need).where("need > 0")
    shares = shares.withColumn("all", F.sum("need").over(all_rows)).withColumn("high", F.sum("need").over(up_to)).withColumn("low", F.col("high") - F.col("need"))
    total = shares.agg(F.sum("need")).first()[0] or 0
    shares = shares.select("source", "need", (F.col("low") / F.col("all")).alias("low"), (F.col("high") / F.col("all")).alias("high"))
    by_cell = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long")))))
    point = (F.pmod(F.col("slot"), F.lit(ROUND)) * GOLDEN) % ROUND / F.lit(float(ROUND))
    slots = spark.range(0, total, 1, max(1, min(20_000, -(-total // (16 * SLOTS_PER_CHUNK))))).withColumnRenamed("id", "slot").withColumn("point", point)
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).join(by_cell, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    slots = slots.select("slot", "source", "need", F.lit(1).cast("long").alias("__one"))
    ranked = common.prefix_sum(slots, "__one", "rank", ["source"], F.floor(F.col("slot") / SLOTS_PER_CHUNK), [F.col("slot")])
    ranked = ranked.where("rank < need").select("slot", "source", "rank")
    had = slots.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("had"))
    short = shares.join(had, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).where("had < need")
    more = short.select("source", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank")).select((F.lit(total) + F.col("rank")).alias("slot"), "source", "rank")
    return ranked.unionByName(more)


def mix(docs: DataFrame, weights: list[int], total: float = 1.5, cap: float = 2.0, block_words: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (uid, doc_id, source, size, source_size, target), the mix (slot, source, uid, start,
    words: the words from `start` of the document, in the order slot, uid), and sources (source, source_size, target, goal).

    docs: uid (long, unique), doc_id, source, size, draw and draw2 (hashes of the document); a stored table. Documents
    without words are in no slot. An empty table, or one without words, gives an empty mix. A null source is a source
    of its own. The order is that of draw, draw2: it does not depend on how docs are split, so reruns agree; uid only
    tells apart rows that are equal.
    """
    sources = common.stored(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, cap), "mix-sources")
    placed = common.prefix_sum(docs.where("size > 0"), "size", "at", ["source"], F.shiftright(F.col("draw"), 50), [F.col("draw"), F.col("draw2"), F.col("uid")])
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    pieces = pieces.select("source", "block", "uid", (begin - F.col("at")).alias("start"), (begin - F.col("block") * block_words).alias("within"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - begin).alias("words"))
    slots = schedule(sources, block_words).withColumnRenamed("source", "__s")
    slots = slots.join(sources.select(F.col("source").alias("__t"), "source_size", "goal"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    blocks = F.ceil(F.col("source_size") / block_words)
    slots = slots.withColumn("block", F.col("rank") % blocks)
    left = F.col("goal") - (F.floor(F.col("rank") / blocks) * F.col("source_size") + F.col("block") * block_words)
    slots = slots.select("slot", "__s", F.col("block").alias("__b"), left.alias("left"))
    # a source's blocks are many, so the pair (source, block) spreads even a source with most of the rows
    taken = pieces.join(slots, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    words = F.least(F.col("words"), F.col("left") - F.col("within"))
    taken = taken.select("slot", "source", "uid", "start", words.alias("words")).where("words > 0")
    known = docs.join(sources.select(F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return known, taken, sources


SEED = 17


def drawn(docs: DataFrame, uid: str) -> dict[str, Column]:
    """The columns that mix() needs of docs (doc_id, source, text), but for `uid`, which numbers the rows already."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "text", "source")
    return {"uid": F.col(uid), "doc_id": F.col("doc_id"), "source": F.col("source"), "size": n_words(F.col("text")), "draw": hashed(SEED), "draw2": hashed(SEED + 1)}


def taken_by_row(rows: DataFrame, weights: list[int], total: float, cap: float) -> DataFrame:
    """uid, doc_id, size, source_size, target, taken of each row of a stored table as mix() needs it."""
    known, taken, _ = mix(rows, weights, total, cap)
    by_row = taken.groupBy("uid").agg(F.sum("words").alias("taken"))
    return known.join(by_row, "uid", "left").select("uid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def taken_words(docs: DataFrame, weights: list[int] = [3, 1, 2], total: float = 1.5, cap: float = 2.0) -> DataFrame:  # noqa: B006
    """doc_id, size, source_size, target, taken of every document (see mix); only doc_id, source and text are read.

    A null text has size 0; documents without words have taken 0. Equal rows are separate documents. An empty table
    gives an empty one.
    """
    numbered = docs.select("doc_id", "source", "text").withColumn("uid", F.monotonically_increasing_id())
    rows = common.stored(numbered.select(*(c.alias(name) for name, c in drawn(numbered, "uid").items())), "mix-rows")
    return taken_by_row(rows, weights, total, cap).drop("uid")


def mixed_documents(docs: DataFrame, weights: list[int] = [3, 1, 2], total: float = 1.5, cap: float = 2.0) -> DataFrame:  # noqa: B006
    """The rows of docs as often as the mix takes them, with all their columns, whatever their names.

    A document that the mix takes in part at a source's end is there if that is at least half of it. Documents
    without words (and with a null text), of which a mix can take none, stay once. A null source is a source of its
    own. Of rows that are equal in doc_id, source and text, any may be the one that is taken more often. An empty
    table gives an empty one.
    """
    uid, copy, times = (common.spare(docs, x) for x in ("uid", "copy", "times"))
    rows = common.stored(docs.withColumn(uid, F.monotonically_increasing_id()), "mix-docs")
    slim = common.stored(rows.select(*(c.alias(name) for name, c in drawn(rows, uid).items())), "mix-rows")
    often = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    taken = taken_by_row(slim, weights, total, cap).select(F.col("uid").alias(uid), often.alias(times)).where(F.col(times) > 0)
    return rows.join(taken, uid).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken_words of all documents."""
    return taken_words(common.documents(spark, sf_dir))
