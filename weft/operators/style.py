"""Style scans: rules in order of priority that own what they match, a score and a grade."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import dictionary


@dataclass(frozen=True)
class StyleRule:
    name: str
    pattern: str
    severity: str = "medium"


#: What an issue costs, by severity.
WEIGHTS = {"high": 5.0, "medium": 2.0, "low": 0.5}
#: Rules for Latin-script corpora.
RULES = (
    StyleRule("symbols", r"[#*$%&|<>]{2,}", "high"),
    StyleRule("shouting", r"\b[A-Z]{2,}(?:[ !]+[A-Z]{2,}){2,}", "high"),
    StyleRule("repeated_word", r"\b(\w+) \1\b", "medium"),
    StyleRule("long_run", r"[^.!?\n]{400,}", "low"),
)


def issues(text: str, rules: tuple[StyleRule, ...] = RULES) -> list[tuple[str, str, int, int]]:
    """(rule, severity, start, end) in page order; a later rule gets nothing that overlaps what an earlier one owns."""
    owned: list[tuple[int, int]] = []
    out = []
    for rule in rules:
        for m in re.finditer(rule.pattern, text):
            if m.end() > m.start() and all(m.end() <= a or b <= m.start() for a, b in owned):
                owned.append(m.span())
                out.append((rule.name, rule.severity, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[2], x[0]))


def scan(rows: DataFrame, key: str, text: str, rules: tuple[StyleRule, ...] = RULES) -> DataFrame:
    """key, rule, severity, start, end, line (from 1), context (18 characters around) of every issue of every row."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, *x, t.count("\n", 0, x[2]) + 1, t[max(0, x[2] - 18) : x[3] + 18]) for k, t in zip(frame[key], frame[text].fillna(""), strict=True) for x in issues(t, rules)]
            yield pd.DataFrame(found, columns=[key, "rule", "severity", "start", "end", "line", "context"])

    return rows.select(key, text).mapInPandas(step, f"{key} {dict(rows.dtypes)[key]}, rule string, severity string, start int, end int, line int, context string")


def score(found: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, issues, score (100 less 2.2 for each weight in 1,000 characters, at least 500), grade of every row."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("severity"))
    by_key = found.groupBy(key).agg(F.count("*").alias("issues"), F.sum(weight).alias("w"))
    thousands = F.greatest(F.length(F.coalesce(text, F.lit(""))) / 1000, F.lit(0.5))
    out = rows.join(by_key, key, "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    points = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 2.2 * F.coalesce("w", F.lit(0.0)) / thousands))
    return out.select(key, "issues", points.alias("score")).withColumn("grade", grade(F.col("score")))


def grade(points: Column) -> Column:
    return F.when(points >= 90, "A").when(points >= 75, "B").when(points >= 55, "C").otherwise("D")


def probed(texts: DataFrame, key: str, text: str, probes: DataFrame, hanging: list[str], tail: int = 60) -> DataFrame:
    """key, chars, paragraphs, closed (ends in a sentence mark), hangs (a hanging mark in the last `tail` characters), hits: an
    array of (beat, words, n, first) for each beat with a word in the text: how many of its words, how often all of them,
    and where the first one is, in hundredths of the text. probes: beat, word; each text is read once for all words."""
    t = F.col(text)
    own = texts.where(t.isNotNull()).select(key, t.alias("__t"))
    found = dictionary.counted(own, "__t", probes, "word").withColumn("__at", F.floor(F.col("first") * 100 / F.length("__t")).cast("int"))
    by = found.select(key, "word", "n", "__at").join(probes.select("beat", "word").distinct(), "word").groupBy(key, "beat").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("__at").alias("first"))
    hits = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("beat", "words", "n", "first"))).alias("hits"))
    end = F.right("__t", F.lit(tail))
    marks = F.array(*map(F.lit, hanging)) if hanging else F.array().cast("array<string>")
    facts = own.select(key, F.length("__t").alias("chars"), F.size(F.filter(F.split("__t", "\n\n"), lambda p: F.trim(p) != "")).alias("paragraphs"), F.rtrim(F.translate("__t", "\n", " ")).rlike(r"[.!?。！？]$").alias("closed"), F.exists(marks, lambda m: F.contains(end, m)).alias("hangs"))
    return facts.join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.array().cast(dict(hits.dtypes)["hits"])))
