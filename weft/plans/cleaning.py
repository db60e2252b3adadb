"""A cleaning plan of a corpus: one action for each text, the defects that it has, and both by book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import cleaning


def plan(rows: DataFrame, key: str, book: str, seq: str, name: str, text: str, number: Column, anchor: str, marker: str, delta: int = 100, whole: float = 0.8) -> DataFrame:
    """key, book, seq (which may be the key), action, rule, cut, tail, end of each text that isn't null.

    action: B (the whole text goes) for one whose numbering restarted (rule restart) or that is foreign for the most part (foreign);
    A (cut it at the line `cut`) for one with a foreign tail (tail); R for a name to be cleaned (name); none. The first that
    holds counts. end: what the last line says of the text that is left (see cleaning.last_line), null for B.

    A book's usual offset comes from counts; all else is found within the row, in one pass over the texts.
    """
    names = [*dict.fromkeys((key, book, seq))]
    numbered = rows.select(*names, F.col(name).alias("__name"), text, number.alias("__no"))
    told = cleaning.restarts(numbered, book, seq, "__no", delta)
    found = cleaning.injected(told, key, text, anchor, marker, keep=(book, seq, "__name", text, "restarted"))
    kind = cleaning.injection_decision(F.col("cut"), F.col("share"), whole)
    rule = F.when(F.col("restarted"), "restart").when(kind == "whole", "foreign").when(kind == "tail", "tail").when(cleaning.cleaned_name(F.col("__name")).isNotNull(), "name").otherwise("none")
    ruled = found.withColumn("rule", rule).withColumn("action", F.when(F.col("rule").isin("restart", "foreign"), "B").when(F.col("rule") == "tail", "A").when(F.col("rule") == "name", "R").otherwise("none"))
    left = F.when(F.col("action") == "A", cleaning.before_line(F.col(text), F.col("cut"))).otherwise(F.col(text))
    end = F.when(F.col("action") != "B", cleaning.last_line(left))
    return ruled.select(*names, "action", "rule", F.when(F.col("rule") == "tail", F.col("cut")).alias("cut"), F.when(F.col("rule") == "tail", F.col("tail")).otherwise(0).alias("tail"), end.alias("end"))


def overview(planned: DataFrame, book: str) -> DataFrame:
    """book, texts, cut, quarantined, renamed, truncated, characters (that cuts take) of each book."""
    n = lambda test, to: F.count_if(test).alias(to)
    return planned.groupBy(book).agg(F.count("*").alias("texts"), n(F.col("action") == "A", "cut"), n(F.col("action") == "B", "quarantined"), n(F.col("action") == "R", "renamed"), n(F.coalesce(F.col("end") == "truncated", F.lit(False)), "truncated"), F.sum("tail").cast("long").alias("characters"))


def defects(planned: DataFrame, book: str, seq: str) -> DataFrame:
    """book, defect, places: for each rule that took something, and for truncated ends, the places of a book that have it."""
    each = F.array_compact(F.array(F.when(F.col("rule") != "none", F.col("rule")), F.when(F.col("end") == "truncated", "truncated")))
    return planned.select(book, seq, F.explode(each).alias("defect")).groupBy(book, "defect").agg(F.array_sort(F.collect_set(seq)).alias("places"))
