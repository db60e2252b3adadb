"""Corpus cleaning: rule tables for lines, inline removal, quarantine decisions, tails."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str


#: Rules for Latin-script corpora; others are passed as tables of the same form.
LINE_RULES = (
    Rule("licence", r"(?i)^\s*(licen[sc]ed under|copyright|all rights reserved|\(c\)).*$"),
    Rule("link", r"(?i)^\s*(https?://|www\.)\S+\s*$"),
    Rule("rule", r"^\s*([-=*_#~])\1{3,}\s*$"),
    Rule("junk", r"^[^\p{L}\p{N}]*$"),
)
INLINE_RULES = (
    Rule("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("link", r"https?://[^\s<>\"]+"),
    Rule("symbols", r"[#*$%&|]{3,}"),
    Rule("entity", r"&[a-z]+;"),
)


def line_class(line: Column, rules: tuple[Rule, ...] = LINE_RULES) -> Column:
    """blank, the name of the first rule that the whole line matches, or body."""
    out = F.when(F.trim(line) == "", "blank")
    for r in rules:
        out = out.when(line.rlike(r.pattern), r.name)
    return out.otherwise("body")


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def class_counts(rows: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = LINE_RULES) -> DataFrame:
    """Lines of each class for each key."""
    return lines(rows, key, text).groupBy(key, line_class(F.col("line"), rules).alias("line_class")).agg(F.count("*").alias("n_lines"))


def body(text: Column, rules: tuple[Rule, ...] = LINE_RULES) -> Column:
    """Text without the lines that a rule matches; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: line_class(x, rules).isin("blank", "body")), "\n")


def inline(text: Column, rules: tuple[Rule, ...] = INLINE_RULES) -> tuple[Column, dict[str, Column]]:
    """Text without what the rules match, one rule after the other, and each rule's number of matches."""
    hits = {}
    for r in rules:
        hits[r.name] = F.regexp_count(text, F.lit(r.pattern))
        text = F.regexp_replace(text, r.pattern, "")
    return text, hits


def share_of(text: Column, pattern: str) -> Column:
    """The share of non-blank characters in lines that match a pattern; 0 for no characters."""
    chars = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"\s+", "")))
    all_ = F.split(text, "\n")
    return F.coalesce(F.try_divide(chars(F.filter(all_, lambda x: x.rlike(pattern))), chars(all_)), F.lit(0.0))


def quarantine(words: Column, symbols: Column, repeats: Column, copies: Column, hits: Column) -> Column:
    """The first reason that holds: empty, short, symbols, repeats, copy, noise; none otherwise."""
    return F.when(words == 0, "empty").when(words < 10, "short").when(symbols > 0.1, "symbols").when(repeats > 0.3, "repeats").when(copies > 1, "copy").when(hits > 0, "noise").otherwise("none")


def last_line(text: Column, talk: str = r"(?i)(to be continued|stay tuned|see you|thanks for reading)") -> Column:
    """clean, author_talk, truncated (no sentence end), or empty: what the last line that is not blank says of a text."""
    last = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(-1))
    return F.when(last.isNull(), "empty").when(last.rlike(talk), "author_talk").when(F.trim(last).rlike(r"[.!?…\"'”’)\]]$"), "clean").otherwise("truncated")


def repeated_lines(rows: DataFrame, key: str, text: str, least: int = 40) -> DataFrame:
    """Lines of at least `least` characters that a row has more than once, and how often."""
    return lines(rows, key, text).where(F.length("line") >= least).groupBy(key, "line").agg(F.count("*").alias("n")).where("n > 1")


def without_tail_block(rows: DataFrame, text: str, strong: str, weak: str, line_limit: int = 120, total_limit: int = 300, most_lines: int = 12) -> DataFrame:
    """Removes a block of notice lines at a text's end, if one of them has the strong mark. Adds n_tail."""
    import re

    def cut(value: str | None) -> tuple[str | None, int]:
        parts = (value or "").split("\n")
        at, size, sure = len(parts), 0, False
        while at > 0 and len(parts) - at < most_lines:
            line = parts[at - 1]
            if len(line) > line_limit or size + len(line) > total_limit or (line.strip() and not re.search(weak, line) and not re.search(strong, line)):
                break
            sure |= bool(re.search(strong, line))
            size, at = size + len(line), at - 1
        return ("\n".join(parts[:at]), len(parts) - at) if sure else (value, 0)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [cut(x) for x in frame[text]]
            yield frame.assign(**{text: [x for x, _ in found], "n_tail": [n for _, n in found]})

    return rows.mapInPandas(step, rows.select("*", F.lit(0).cast("long").alias("n_tail")).schema)


def stacked_words(rows: DataFrame, key: str, text: str, words: list[str], least: int = 40, same: int = 2, total: int = 4) -> DataFrame:
    """key, line_no, finding: paragraphs of `least` characters or more with one of the words `same` times (repeat), or
    else with `total` of them (density)."""
    own = F.split("line", r"[^\p{L}\p{N}]+")
    times = lambda word: F.size(F.filter(own, lambda x: x == F.lit(word)))
    counts = F.array(*map(times, words))
    found = lines(rows, key, text).where(F.length("line") >= least).withColumn("__n", counts)
    finding = F.when(F.array_max("__n") >= same, "repeat").when(F.aggregate("__n", F.lit(0), lambda a, b: a + b) >= total, "density")
    return found.select(key, "line_no", finding.alias("finding")).where("finding is not null")


def injected(rows: DataFrame, key: str, text: str, anchor: str, marker: str, run: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, cut (number of the line, null for none), tail and body (characters of lines from there on, and before), share, and
    the columns `keep` of rows. Null texts are left out.

    The cut is the first line that matches `anchor`, or the first of `run` lines or more in a row that match `marker`. A text
    is split once, and its lines become a string of a digit each, in which the cut is a match: nothing leaves the row.
    """
    digit = lambda x: F.when(x.rlike(anchor), 2).otherwise(0) + F.when(x.rlike(marker), 1).otherwise(0)
    kept = [*dict.fromkeys(c for c in keep if c != key)]
    split = rows.where(F.col(text).isNotNull()).select(key, *kept, F.split(text, "\n").alias("__lines"))
    at = F.regexp_instr(F.array_join(F.transform("__lines", lambda x: digit(x).cast("string")), ""), F.lit(rf"[23]|[13]{{{run}}}"))
    placed = split.select(key, *kept, F.nullif(at, F.lit(0)).alias("cut"), F.transform("__lines", F.length).alias("__n"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda n, x: n + x)
    sizes = placed.select(key, *kept, "cut", F.when(F.col("cut").isNull(), 0).otherwise(total(F.slice("__n", F.coalesce("cut", F.lit(1)), F.size("__n")))).alias("tail"), total("__n").alias("all"))
    return sizes.select(key, *kept, "cut", "tail", (F.col("all") - F.col("tail")).alias("body"), F.coalesce(F.try_divide("tail", "all"), F.lit(0.0)).alias("share"))


def injection_decision(cut: Column, share: Column, whole: float = 0.8) -> Column:
    """whole (most of the text is foreign), tail (cut it there), none."""
    return F.when(cut.isNull(), "none").when(share >= whole, "whole").otherwise("tail")


def before_line(text: Column, cut: Column) -> Column:
    """The text before a line's number as cleaning.lines counts it; all of it for null."""
    parts = F.split(text, "\n")
    return F.when(cut.isNull(), text).otherwise(F.array_join(F.slice(parts, F.lit(1), cut.cast("int") - 1), "\n"))


def restarts(rows: DataFrame, book: str, seq: str, number: str, delta: int) -> DataFrame:
    """rows with usual (the commonest seq - number of the book, of equally common ones the smallest) and restarted: the
    number inside is more than `delta` further behind than usual, as in a sequel that counts anew. Rows without a number
    haven't restarted. Offsets are counted, and a row for each book comes back."""
    offset = F.col(seq) - F.col(number)
    counts = rows.where(offset.isNotNull()).groupBy(book, offset.alias("__o")).agg(F.count("*").alias("__n"))
    usual = counts.groupBy(book).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__o").alias("o"))).getField("o").alias("usual"))
    return rows.join(usual, book, "left").withColumn("restarted", F.coalesce(offset - F.col("usual") > delta, F.lit(False)))


def cleaned_name(name: Column) -> Column:
    """The name without control characters, with single blanks, trimmed; null if that is the same, or nothing."""
    new = F.trim(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1F\x7F]", ""), r"\s{2,}", " "))
    return F.when((new != "") & (new != name) & name.rlike(r"[\x00-\x1F\x7F]"), new)


def renames(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, old, new, state of rows whose name is to be cleaned: rename, or taken if another row has the new name or gets it
    too (the first by key gets it if no one has it)."""
    wanted = rows.select(key, F.col(name).alias("old"), cleaned_name(F.col(name)).alias("new")).where("new is not null")
    first = wanted.groupBy("new").agg(F.min(key).alias("__first"))
    there = rows.select(F.col(name).alias("new"), F.lit(True).alias("__there")).distinct()
    both = wanted.join(first, "new").join(there, "new", "left")
    return both.select(key, "old", "new", F.when(F.col("__there").isNotNull() | (F.col(key) != F.col("__first")), "taken").otherwise("rename").alias("state"))


def trimmed_tail(text: Column, noise: str, most: int = 60) -> Column:
    """text without what follows the first match of noise, if that is no more than `most` characters and something stays; a
    comma or colon that is then the last becomes a full stop. Null where nothing is to be cut."""
    at = F.regexp_instr(text, F.lit(noise))
    kept = F.rtrim(F.substring(text, F.lit(1), at - 1))
    closed = F.when(kept.rlike("[,;:，、；：]$"), F.concat(F.regexp_replace(kept, "[,;:，、；：]+$", ""), F.lit("."))).otherwise(kept)
    return F.when((at > 0) & (kept != "") & (F.length(text) - at + 1 <= most), closed)
