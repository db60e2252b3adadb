"""Segmentation: chunks, packed batches, windows, cuts, coverage and repair of interval partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack_paragraphs(paragraphs: list[str], limit: int) -> list[str]:
    """Chunks of whole paragraphs of at most `limit` characters; a longer paragraph is cut hard."""
    out: list[str] = []
    held = ""
    for p in paragraphs:
        if held and len(held) + 1 + len(p) > limit:
            out.append(held)
            held = ""
        while len(p) > limit:
            out.append(p[:limit])
            p = p[limit:]
        held = f"{held}\n{p}" if held and p else held or p
    return [*out, held] if held else out


def chunks(rows: DataFrame, key: str, text: str, limit: int = 500) -> DataFrame:
    """key, chunk_no (from 0), chunk of every text."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, i, c) for k, value in zip(frame[key], frame[text], strict=True) for i, c in enumerate(pack_paragraphs([p.strip() for p in (value or "").split("\n") if p.strip()], limit))]
            yield pd.DataFrame(found, columns=[key, "chunk_no", "chunk"])

    return rows.select(key, text).mapInPandas(step, f"{key} {dict(rows.dtypes)[key]}, chunk_no int, chunk string")


def batches(rows: DataFrame, group: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """Adds batch (from 0): rows of a group in order, closed at `most_items` rows or before `most_size` is passed.

    A larger row is a batch of its own. The fold is sequential within a group, so groups must fit a task.
    """

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        out, batch, n, total = [], 0, 0, 0
        for s in frame[size]:
            if n and (n >= most_items or total + s > most_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append(batch)
        return frame.assign(batch=out)

    return rows.groupBy(group).applyInPandas(step, rows.select("*", F.lit(0).alias("batch")).schema)


def next_places(rows: DataFrame, group: str, at: str, width: int = 10_000) -> DataFrame:
    """Slim rows with next, the following `at` (a number, unique in a group) of their group, null for the last.

    Rows follow each other in ranges of `width` numbers, each of which is in one task at most; the last of a range finds
    the next range's first in a table of a row for each range.
    """
    cut = rows.withColumns({"__group": F.struct(group), "__range": F.floor(F.col(at) / width)})
    first = cut.groupBy("__group", "__range").agg(F.min(at).alias("__first"))
    first = first.select("__group", "__range", F.lead("__first").over(Window.partitionBy("__group").orderBy("__range")).alias("__beyond"))
    inner = cut.withColumn("__in", F.lead(at).over(Window.partitionBy("__group", "__range").orderBy(at)))
    return inner.join(first, ["__group", "__range"]).withColumn("next", F.coalesce("__in", "__beyond")).drop("__group", "__range", "__in", "__beyond")


def with_next(rows: DataFrame, group: str, at: str, width: int = 10_000) -> DataFrame:
    """Adds next (see next_places) to rows of any size, whose `at` is unique in all groups: only two columns go through
    windows."""
    return rows.join(next_places(rows.select(group, at), group, at, width).select(at, "next"), at, "left")


def windows(spans: DataFrame, core: int, tail: int) -> DataFrame:
    """For spans (key, first, last): windows of `core` places with `tail` more to look ahead: lo, core_end, need."""
    out = spans.withColumn("lo", F.explode(F.sequence("first", "last", F.lit(core))))
    return out.withColumn("core_end", F.least(F.col("lo") + core - 1, F.col("last"))).withColumn("need", F.least(F.col("lo") + core + tail - 1, F.col("last")))


def from_cuts(cuts: DataFrame, key: str, cut: str, last: str) -> DataFrame:
    """Disjoint intervals that begin at the cuts and cover up to last: key, lo, hi."""
    places = next_places(cuts.select(key, cut, last).distinct(), key, cut)
    return places.select(key, F.col(cut).alias("lo"), F.coalesce(F.col("next") - 1, F.col(last)).alias("hi"))


def coverage(intervals: DataFrame, key: str) -> DataFrame:
    """Places of each key that intervals (lo, hi) cover, and those that more than one covers."""
    places = intervals.select(key, F.explode(F.sequence("lo", "hi")).alias("place")).groupBy(key, "place").agg(F.count("*").alias("n"))
    return places.groupBy(key).agg(F.count("*").alias("covered"), F.count_if(F.col("n") > 1).alias("doubled"))


def repair(intervals: list[tuple[int, int]], first: int, last: int) -> list[tuple[int, int]]:
    """A strict partition of first..last: intervals clamped, ordered, cut where they overlap, gaps given to the left one."""
    out: list[tuple[int, int]] = []
    at = first
    for lo, hi in sorted((max(first, lo), min(last, hi)) for lo, hi in intervals):
        lo = max(lo, at)
        if lo > hi:
            continue
        if lo > at:
            if out:
                out[-1] = (out[-1][0], lo - 1)
            else:
                lo = first
        out.append((lo, hi))
        at = hi + 1
    if not out:
        return [(first, last)]
    out[-1] = (out[-1][0], last)
    return out


def repaired(intervals: DataFrame, key: str) -> DataFrame:
    """key, lo, hi: the repaired partition of each key's intervals (lo, hi) over its (first, last)."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        fixed = repair(list(zip(frame.lo, frame.hi, strict=True)), int(frame["first"].iloc[0]), int(frame["last"].iloc[0]))
        return pd.DataFrame({key: frame[key].iloc[0], "lo": [a for a, _ in fixed], "hi": [b for _, b in fixed]})

    return intervals.groupBy(key).applyInPandas(step, f"{key} {dict(intervals.dtypes)[key]}, lo long, hi long")


def glued(rows: DataFrame, key: str, at: str, text: str, least: int = 12) -> DataFrame:
    """Lines with those shorter than `least` glued to the line before; leading short ones are dropped."""
    by = Window.partitionBy(key).orderBy(at)
    part = F.sum((F.length(text) >= least).cast("int")).over(by)
    return rows.withColumn("part", part).where("part > 0").groupBy(key, "part").agg(F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY {at})").alias(text))


def merged_neighbours(segments: DataFrame, key: str, at: str, similarity: Column, least: float) -> DataFrame:
    """Adds merged: a number shared by neighbours along `at` that are at least `least` alike."""
    by = Window.partitionBy(key).orderBy(at)
    return segments.withColumn("merged", F.sum(F.coalesce((similarity < least).cast("int"), F.lit(1))).over(by))


def cut_clusters(cuts: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """key, cut: one for each run of a key's cuts that are at most `gap` apart: the upper median of its different places."""
    by = Window.partitionBy(key).orderBy(at)
    places = cuts.select(key, at).where(F.col(at).isNotNull()).distinct().withColumn("__new", F.when(F.col(at) - F.lag(at).over(by) <= gap, 0).otherwise(1))
    runs = places.withColumn("__run", F.sum("__new").over(by)).groupBy(key, "__run").agg(F.array_sort(F.collect_list(at)).alias("__all"))
    return runs.select(key, F.element_at("__all", (F.floor(F.size("__all") / 2) + 1).cast("int")).alias("cut"))


def kept_cuts(cuts: list[int], first: int, last: int, least: int) -> list[int]:
    """Cuts (begins of new arcs) without those that make an arc shorter than `least`: of the shortest arc (the first of
    equal ones), the cut at its begin goes, or that at its end if it is the first arc."""
    kept = sorted({c for c in cuts if first < c <= last})
    while kept:
        edges = [first, *kept, last + 1]
        sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        short = min(range(len(sizes)), key=lambda i: sizes[i])
        if sizes[short] >= least:
            break
        del kept[max(short - 1, 0)]
    return kept


def stitched(cuts: DataFrame, spans: DataFrame, key: str, at: str, gap: int = 4, least: int = 8) -> DataFrame:
    """key, lo, hi: the arcs of spans (key, first, last) between clustered cuts (cut_clusters), none shorter than `least`
    unless the span is (kept_cuts). A key's cuts are folded in one row."""

    @F.udf("array<struct<lo:long,hi:long>>", useArrow=True)
    def arcs(found: list[int] | None, first: int, last: int) -> list[tuple[int, int]]:
        edges = [first, *kept_cuts([int(c) for c in (found if found is not None else [])], first, last, least), last + 1]
        return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]

    by = cut_clusters(cuts, key, at, gap).groupBy(key).agg(F.collect_list(F.col("cut").cast("long")).alias("__cuts"))
    whole = spans.join(by, key, "left").withColumn("__arc", F.explode(arcs("__cuts", F.col("first").cast("long"), F.col("last").cast("long"))))
    return whole.select(key, "__arc.lo", "__arc.hi")


def arc_report(arcs: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """For each key: arcs, their mean length, how many are shorter or longer than wanted, and places they cover."""
    n = F.col("hi") - F.col("lo") + 1
    return arcs.groupBy(key).agg(F.count("*").alias("arcs"), F.avg(n).alias("mean"), F.count(F.when(n < least, 1)).alias("short"), F.count(F.when(n > most, 1)).alias("long"), F.sum(n).alias("covered"))


def segmented(places: DataFrame, proposals: DataFrame, key: str, at: str, begun: DataFrame | None = None) -> DataFrame:
    """key, at, segment (from 1, along the places): places in the proposed interval (lo, hi) that begins first, of equal ones the
    longest; a place that none covers is a segment of its own, and so no place of a key is lost. Proposals that end before
    they begin are none.

    begun: places (key, at, segment) that have their segment from an earlier run, which keep it; the others are numbered on
    from a key's largest one.
    """
    open_ = places.select(key, at).distinct()
    if begun is not None:
        open_ = open_.join(begun.select(key, at), [key, at], "left_anti")
    own = lambda lo, back: F.struct(lo.cast("long").alias("lo"), back.cast("long").alias("back"))
    covered = proposals.where("lo <= hi").select(key, own(F.col("lo"), -F.col("hi")).alias("__p"), F.explode(F.sequence("lo", "hi")).alias(at))
    first = covered.groupBy(key, at).agg(F.min("__p").alias("__p"))
    owned = open_.join(first, [key, at], "left").withColumn("__p", F.coalesce("__p", own(F.col(at), F.lit(1))))
    heads = owned.groupBy(key, "__p").agg(F.min(at).alias("__head"))
    out = owned.join(running_number(heads, key, "__head"), [key, "__p"])
    if begun is None:
        return out.select(key, at, F.col("__n").alias("segment"))
    last = begun.groupBy(key).agg(F.max("segment").alias("__last"))
    new = out.join(last, key, "left").select(key, at, (F.col("__n") + F.coalesce("__last", F.lit(0))).alias("segment"))
    return begun.select(key, at, F.col("segment").cast("long").alias("segment")).unionByName(new)


def running_number(rows: DataFrame, key: str, at: str) -> DataFrame:
    """rows with __n, their number along `at` within the key, in ranges of it: no window over a whole key."""
    from weft.operators import windows as W

    return W.numbered(rows, [key], at, "__n")
