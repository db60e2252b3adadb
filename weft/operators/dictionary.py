"""Literal phrases in texts by an automaton: one pass over each text, whatever the number of phrases.

The phrases are one trie with failure links, sent to every task; a text's hits come out at the characters where they end.
A dictionary is sent while its characters are at most MOST_CHARS, which is counted before; a larger one is joined by
hashes of words and first characters (`anchored`), so that no task holds it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType

from weft.functions import text as T

#: Characters of all phrases up to which a dictionary is sent to every task (about 100 bytes of trie for each).
MOST_CHARS = 4 << 20

Automaton = ahocorasick.Automaton
_last: list = []  # of a Python worker: the last dictionary that it has seen, and its automaton


def automaton(phrases: list[str]) -> Automaton:
    """Of distinct phrases that aren't empty; a hit's value is the phrase's number and length."""
    out = Automaton()
    for i, p in enumerate(phrases):
        out.add_word(p, (i, len(p)))
    out.make_automaton()
    return out


def held(phrases: DataFrame, phrase: str) -> list[str] | None:
    """The distinct phrases, the longest first, or None if they are too many characters to send. An empty one is left out."""
    known = phrases.select(F.col(phrase).alias("p")).where("p <> ''").distinct()
    size = known.agg(F.sum(F.length("p").cast("long"))).first()[0] or 0
    return sorted((r.p for r in known.collect()), key=lambda p: (-len(p), p)) if size <= MOST_CHARS else None


def scanner(spark: SparkSession, phrases: list[str], scan: Callable[[Automaton, str], object], kind: DataType):
    """A vectorised function of a text column: scan(automaton, text) of each text that isn't null."""
    sent = spark.sparkContext.broadcast(phrases)

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        words = sent.value
        if not _last or _last[0] is not words:
            _last[:] = words, automaton(words)
        own = _last[1]
        return pd.Series([None if t is None else scan(own, t) for t in texts], dtype=object)

    return run


def _numbers(own: Automaton, text: str) -> list[int]:
    return sorted({i for _, (i, _) in own.iter(text)}) if len(own) else []


def contained(texts: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """Pairs of rows where the text contains the phrase; phrases may be of any length, an empty one is in every text.

    Linear in the texts and their hits. Only the texts go to Python; phrases come back by their numbers. Nulls are in no
    pair. Equal rows are all returned. Columns of phrases that texts have too are left out.
    """
    spark, words = texts.sparkSession, held(phrases, phrase)
    if words is None:
        return anchored(texts, phrases, text, phrase)
    own = [c for c in phrases.columns if c not in texts.columns]
    rows = texts.where(F.col(text).isNotNull())
    numbers = spark.createDataFrame([(p, i) for i, p in enumerate(words)], f"`{phrase}` string, __i int")
    known = phrases.where(F.col(phrase).isNotNull()).join(F.broadcast(numbers), phrase, "left").select(F.coalesce("__i", F.lit(-1)).alias("__i"), *own)
    # number -1 is the empty phrase, which every text has
    hits = F.concat(F.array(F.lit(-1)), scanner(spark, words, _numbers, ArrayType(IntegerType()))(F.col(text)))
    found = rows.withColumn("__i", F.explode(hits))
    return found.join(known, "__i").select(*texts.columns, *own)


def anchored(texts: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """contained() for a dictionary of any size: by equi-joins of hashes, with an exact test behind them.

    A phrase of four words or more has its second and third word in the text as whole words: texts' pairs of words are
    matched with these, and shorter phrases' first characters (up to four) with the texts' runs of as many. Only hashes
    of texts and phrases go through these joins; rows with a match come back by their hash. Texts are split once.
    """
    known = phrases.where(F.col(phrase).isNotNull()).withColumn("__p", F.xxhash64(phrase))
    rows = texts.where(F.col(text).isNotNull()).withColumn("__t", F.xxhash64(text))
    blank = r"[ \t\n\x0B\f\r]+"
    split = known.select("__p", F.col(phrase).alias("x"), F.split(F.trim(phrase), blank).alias("w"))
    long = split.where(F.size("w") >= 4).select("__p", F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("__key")).distinct()
    short = split.where(F.size("w") < 4).select("__p", F.least(F.length("x"), F.lit(4)).alias("__n"), F.substring("x", 1, 4).alias("__key")).distinct()
    body = rows.select("__t", F.col(text).alias("x"))
    # the words are bound once by a lambda over an array of one, so that no pair splits the text again
    pairs = F.transform(F.array(F.split("x", blank)), lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b)))
    hits = [body.select("__t", F.explode(F.array_distinct(F.flatten(pairs))).alias("__key")).join(long, "__key")]
    for n in range(5):
        runs = T.grams(F.col("x"), n) if n else F.array(F.lit(""))
        hits.append(body.select("__t", F.explode(F.array_distinct(runs)).alias("__key")).join(short.where(F.col("__n") == n), "__key"))
    met = reduce(DataFrame.unionByName, (h.select("__t", "__p") for h in hits)).distinct()
    # a text's candidates are gathered, not the text repeated for each of them
    own = known.select("__p", F.col(phrase).alias("__x")).distinct()
    candidates = met.join(own, "__p").groupBy("__t").agg(F.collect_list("__x").alias("__c"))
    hit = F.explode(F.filter("__c", lambda p: F.contains(F.col(text), p)))
    found = rows.join(candidates, "__t").withColumn("__hit", hit).join(known.withColumnRenamed(phrase, "__hit"), "__hit").withColumnRenamed("__hit", phrase)
    return found.select(*texts.columns, *(c for c in phrases.columns if c not in texts.columns))


def _counts(own: Automaton, text: str) -> list[tuple[int, int, int]]:
    """Phrase number, hits that don't overlap (the leftmost first), begin of the first, for each phrase in a text."""
    n: dict[int, list[int]] = {}
    if len(own):
        for last, (i, size) in own.iter(text):
            if i not in n:
                n[i] = [1, last + 1 - size, last]
            elif last - size >= n[i][2]:
                n[i][0] += 1
                n[i][2] = last
    return [(i, times, first) for i, (times, first, _) in n.items()]


def counted(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """texts with a row for each distinct phrase that is in them: phrase, n (hits that don't overlap) and first (where the
    first one begins, in characters from 0). Nulls and empty phrases are in no row."""
    spark, words = texts.sparkSession, held(phrases, phrase)
    if words is None:
        rest = F.length(text) - F.length(F.replace(text, F.col(phrase), F.lit("")))
        found = anchored(texts, phrases.select(phrase).where(F.col(phrase) != "").distinct(), text, phrase)
        return found.withColumns({"n": (rest / F.length(phrase)).cast("int"), "first": F.instr(text, F.col(phrase)) - 1})
    numbers = spark.createDataFrame([(i, p) for i, p in enumerate(words)], f"__i int, `{phrase}` string")
    hits = F.explode(scanner(spark, words, _counts, ArrayType(T.COUNTED))(F.col(text)))
    found = texts.withColumn("__h", hits).select(*texts.columns, F.col("__h.i").alias("__i"), "__h.n", "__h.first")
    return found.join(F.broadcast(numbers), "__i").drop("__i")


def findings(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, around: int = 12) -> DataFrame:
    """key, the columns of phrases, n, first, line_no (from 1) and context (the first hit with `around` characters on either
    side, line ends as blanks) of every phrase in every text. A phrase with several rows of phrases is found once for each."""
    spark, words = texts.sparkSession, held(phrases, phrase)
    if words is None:
        raise ValueError(f"phrases have more than {MOST_CHARS} characters: use counted()")

    def told(own: Automaton, value: str) -> list[tuple[int, int, int, int, str]]:
        ends = [i for i, c in enumerate(value) if c == "\n"]
        return [(i, n, at, bisect_left(ends, at) + 1, value[max(0, at - around) : at + len(words[i]) + around].replace("\n", " ")) for i, n, at in _counts(own, value)]

    numbers = spark.createDataFrame([(i, p) for i, p in enumerate(words)], f"__i int, `{phrase}` string")
    found = texts.select(key, F.explode(scanner(spark, words, told, ArrayType(T.FOUND))(F.col(text))).alias("__h")).select(key, F.col("__h.i").alias("__i"), "__h.n", "__h.first", "__h.line_no", "__h.context")
    named = found.join(F.broadcast(numbers), "__i").drop("__i")
    return named.join(phrases, phrase) if phrases.columns != [phrase] else named


def _spans(own: Automaton, text: str) -> list[tuple[int, int, int]]:
    """start, end, phrase number of the hits that are replaced: longer phrases first (numbers ascend as lengths fall), of
    one phrase the leftmost, none over another."""
    if not len(own):
        return []
    taken, out = bytearray(len(text)), []
    for i, start, end in sorted((i, last + 1 - n, last + 1) for last, (i, n) in own.iter(text)):
        # a span taken before is at least as long, so it covers one of this one's ends if they meet
        if not (taken[start] or taken[end - 1]):
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, i))
    return sorted(out)


def replaced(texts: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    """texts with the names of mapping (original, alias) replaced in the columns, and `touched`.

    Longer names go first, so that none is cut by a shorter one inside it, and aliases are not searched again. What a
    column was before is in `<column>_raw`; a table that has that column already keeps it, and is replaced from it: so a
    second run with more names begins from the originals. touched: some column is not what it was in texts. A name with
    several aliases has the first by order. Empty and null names are left out; a null alias removes the name.
    """
    spark = texts.sparkSession
    once = mapping.where("original <> ''").groupBy("original").agg(F.min(F.coalesce("alias", F.lit(""))).alias("alias"))
    names = held(once, "original")
    if names is None:
        raise ValueError(f"names have more than {MOST_CHARS} characters: replace by parts of the mapping")
    alias = {r.original: r.alias for r in once.collect()}  # as many as the names, whose size is bounded
    sent = spark.sparkContext.broadcast([alias[n] for n in names])

    def renamed(own: Automaton, text: str) -> str:
        at, out = 0, []
        for start, end, i in _spans(own, text):
            out += [text[at:start], sent.value[i]]
            at = end
        return "".join([*out, text[at:]])

    replace = scanner(spark, names, renamed, T.STRING)
    raw = {f"{c}_raw": F.coalesce(f"{c}_raw", c) if f"{c}_raw" in texts.columns else F.col(c) for c in columns}
    rows = texts.withColumns({**raw, **{f"__{c}": F.col(c) for c in columns}})
    rows = rows.withColumns({c: replace(F.col(f"{c}_raw")) for c in columns})
    touched = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))
    return rows.withColumn("touched", touched).drop(*(f"__{c}" for c in columns))


def names_in(texts: DataFrame, text: str, names: DataFrame, name: str, out: str = "names") -> DataFrame:
    """texts with `out`, the distinct names that each contains, the longest first."""
    spark, words = texts.sparkSession, held(names, name)
    if words is None:
        raise ValueError(f"names have more than {MOST_CHARS} characters: use contained()")

    def found(own: Automaton, value: str) -> list[str]:
        kept = sorted({i: value[last + 1 - n : last + 1] for last, (i, n) in own.iter(value)}.items()) if len(own) else []
        return [x for _, x in kept]

    return texts.withColumn(out, F.coalesce(scanner(spark, words, found, ArrayType(T.STRING))(F.col(text)), F.array().cast("array<string>")))
