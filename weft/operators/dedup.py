"""Exact and near duplicates of short texts, with provenance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weft.functions import text as T
from weft.operators import intervals, joins


def mark(rows: DataFrame, key: Column, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Adds n_copies and keep (true for the first of equal keys along `order`, which tells all rows apart).

    Copies are counted by an aggregate, and only keys that repeat are joined back, dealt over several tasks: a key with
    most of the rows is in no single one.
    """
    names = [*(group or []), "__key"]
    keyed = rows.withColumns({"__key": key, "__order": F.struct(*order)})
    whole = F.struct(*(F.coalesce(F.col(n).cast("string"), F.lit("\0")) for n in names))  # nulls are equal to each other here
    keyed = keyed.withColumn("__whole", whole)
    copies = keyed.groupBy("__whole").agg(F.count("*").alias("__n"), F.min("__order").alias("__first")).where("__n > 1")
    found = joins.spread(keyed, copies, ["__whole"], "__order")
    return found.withColumns({"n_copies": F.coalesce("__n", F.lit(1).cast("long")), "keep": F.col("__n").isNull() | (F.col("__order") == F.col("__first"))}).drop("__key", "__order", "__whole", "__first", "__n")


def merge_identical(rows: DataFrame, text: str, source: str, order: str) -> DataFrame:
    """One row for texts that are equal without white space: the first text, all sources in first-seen order, n."""
    norm = T.without_space(F.col(text))
    once = rows.groupBy(norm.alias("norm"), source).agg(F.min(order).alias(order), F.min_by(text, order).alias(text), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(source).alias("s")))), lambda x: x["s"])
    return once.groupBy("norm").agg(F.min_by(text, order).alias(text), ordered.alias("sources"), F.sum("n").alias("n")).drop("norm")


def adjacent_overlap(lines: DataFrame, group: str, at: str, lines_column: str, least: float) -> DataFrame:
    """Neighbours along `at` (a number, unique) of a group that share at least `least` of the smaller one's distinct lines."""
    both = intervals.with_next(lines.select(group, at, lines_column), group, at)
    ratio = F.try_divide(F.size(F.array_intersect(lines_column, "__next")), F.least(F.size(F.array_distinct(lines_column)), F.size(F.array_distinct("__next"))))
    behind = lines.select(F.col(at).alias("next"), F.col(lines_column).alias("__next"))
    return both.where("next is not null").join(behind, "next").withColumn("ratio", ratio).where(F.col("ratio") >= least).select(group, at, "next", "ratio")


@F.pandas_udf(DoubleType())
def matched(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters of a pair of short texts; 1 for two empty ones."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def same_meaning(a: Column, b: Column, least: float = 0.85, contain: int = 6, long: int = 12) -> Column:
    """Equal letters and digits; one inside the other (both of `contain` characters or more); or alike (of `long`)."""
    x, y = (F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "") for c in (a, b))
    shorter = F.least(F.length(x), F.length(y))
    inside = (shorter >= contain) & (F.contains(x, y) | F.contains(y, x))
    return (x == y) | inside | F.when(shorter >= long, matched(x, y) >= least).otherwise(False)


def latest_alike(name: str, others: Iterable[str], least: float = 0.85, contain: int = 6, long: int = 12) -> str | None:
    """The first of others that means the same as name by the levels of same_meaning; both of letters and digits only."""
    m = SequenceMatcher(None, "", name, autojunk=False)
    for other in others:
        shorter = min(len(other), len(name))
        if other == name or (shorter >= contain and (other in name or name in other)):
            return other
        if shorter >= long:
            m.set_seq1(other)
            if m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least:
                return other
    return None


def _common_lengths(a: str, others: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of a with each of others, none of which has a line end.

    All others are one number, a bit for each character and a zero bit behind each text, so one pass over a serves all.
    """
    codes = np.frombuffer("".join(x + "\n" for x in others).encode("utf-32-le"), np.uint32)
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    whole = rest = number(codes != 10)
    at = {c: number(codes == ord(c)) for c in set(a)}
    for c in a:
        hit = rest & at[c]
        if hit:
            rest = ((rest + hit) | (rest - hit)) & whole
    bits = np.unpackbits(np.frombuffer(rest.to_bytes(-(-len(codes) // 8), "little"), np.uint8), bitorder="little")
    sizes = np.array([len(x) for x in others])
    return sizes - np.add.reduceat(bits[: len(codes)], np.cumsum(sizes + 1) - sizes - 1, dtype=np.int64)


def _matching(a: str, b: str) -> int:
    """The characters in SequenceMatcher's matching blocks of a and b, without junk: the longest common run, the earliest in
    a and then in b, and what is on either side of it likewise."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    total, open_ = 0, [(0, len(x), 0, len(y))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        part = y[blo:bhi]
        where = {c: np.flatnonzero(part == c) for c in np.unique(x[alo:ahi])}
        best, i0, j0, before = 0, alo, blo, np.zeros(bhi - blo + 1, np.int32)
        for i in range(alo, ahi):
            now, hits = np.zeros_like(before), where[x[i]]
            if len(hits):
                runs = now[hits + 1] = before[hits] + 1
                if (k := runs.max()) > best:
                    best = int(k)
                    i0, j0 = i - best + 1, blo + int(hits[runs.argmax()]) - best + 1
            before = now
        if best:
            total += best
            open_ += [w for w in ((alo, i0, blo, j0), (i0 + best, ahi, j0 + best, bhi)) if w[0] < w[1] and w[2] < w[3]]
    return total


def without_repeated_tail(rows: DataFrame, text: str, least_chars: int = 20, run: int = 3, similarity: float = 0.8, least_paragraphs: int = 6) -> DataFrame:
    """Cuts the end of texts at a run of `run` or more long paragraphs that are each like an earlier one. Adds n_cut.

    Likeness is SequenceMatcher's ratio. The longest common subsequence bounds it, which is found for all earlier
    paragraphs in one pass over the last one; only pairs whose bound passes are matched.
    """

    def cut(value: str | None) -> tuple[str | None, int]:
        parts = [p for p in (value or "").split("\n") if p.strip()]
        if len(parts) < least_paragraphs:
            return value, 0

        def like(a: str, b: str) -> bool:
            x, y = set(a), set(b)
            return len(x & y) >= 0.3 * len(x | y) and 2.0 * _matching(a, b) / (len(a) + len(b)) > similarity

        def repeats(i: int) -> bool:
            p, n = parts[i], len(parts[i])
            if len(p.strip()) < least_chars:
                return False
            near = [q for q in dict.fromkeys(parts[:i]) if abs(n - len(q)) <= 0.4 * max(n, len(q)) and 2.0 * min(n, len(q)) / (n + len(q)) > similarity]
            if p in near:
                return True
            bound = _common_lengths(p, near) if near else ()
            return any(like(p, q) for m, q in sorted(zip(bound, near, strict=True), key=lambda x: -x[0]) if 2.0 * m / (n + len(q)) > similarity)

        at = len(parts)
        while at > 1 and repeats(at - 1):
            at -= 1
        n = len(parts) - at
        return ("\n".join(parts[:at]), n) if n >= run else (value, 0)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [cut(x) for x in frame[text]]
            yield frame.assign(**{text: [x for x, _ in found], "n_cut": [n for _, n in found]})

    return rows.mapInPandas(step, rows.select("*", F.lit(0).cast("long").alias("n_cut")).schema)


def single_link(pairs: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """id, cluster (smallest id that links reach) of every node; pairs: a, b.

    In each round a node takes the smallest label of its neighbours, and then its label's label, so that chains halve;
    rounds end when nothing changes. Labels are checkpointed. Raises if they don't settle.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select("id", F.col("id").alias("cluster"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("__near"))
        low = label.join(near, label.id == near.a, "left").select("id", F.least("cluster", "__near").alias("new"), "cluster")
        jump = low.select(F.col("id").alias("new"), F.col("new").alias("__jump"))
        label = low.join(jump, "new", "left").select("id", F.least("new", "__jump").alias("new"), "cluster").checkpoint()
        if not label.where("new <> cluster").take(1):
            return label.select("id", "cluster")
        label = label.select("id", F.col("new").alias("cluster"))
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")
