"""Comparisons of loosely typed values, as workflow conditions use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    return x.try_cast("double")


def compare(op: str, actual: Column, expected: Column) -> Column:
    """eq ne gt ge lt le contains not_contains start_with end_with empty not_empty; anything else is false.

    Values are compared as numbers if both are numbers, else as strings; a missing value is an empty string.
    """
    a, b = F.coalesce(actual.cast("string"), F.lit("")), F.coalesce(expected.cast("string"), F.lit(""))
    x, y = number(a), number(b)
    both = x.isNotNull() & y.isNotNull()
    either = lambda f: F.when(both, f(x, y)).otherwise(f(a, b))
    return {
        "eq": lambda: either(lambda p, q: p == q),
        "ne": lambda: either(lambda p, q: p != q),
        "gt": lambda: either(lambda p, q: p > q),
        "ge": lambda: either(lambda p, q: p >= q),
        "lt": lambda: either(lambda p, q: p < q),
        "le": lambda: either(lambda p, q: p <= q),
        "contains": lambda: F.contains(a, b),
        "not_contains": lambda: ~F.contains(a, b),
        "start_with": lambda: F.startswith(a, b),
        "end_with": lambda: F.endswith(a, b),
        "empty": lambda: a == "",
        "not_empty": lambda: a != "",
    }.get(op, lambda: F.lit(False))()


def all_or_any(conditions: list[Column], mode: str = "and") -> Column:
    """Conditions joined by `and` or `or`; none at all is true."""
    out = F.lit(True) if mode == "and" or not conditions else F.lit(False)
    for c in conditions:
        out = out & c if mode == "and" else out | c
    return out


def grounded(evidence: Column, text: Column, least: int = 4) -> Column:
    """Whether evidence is from the text: without white space and punctuation, all of its parts between ellipses that
    have `least` letters or digits or more are in it, and it has such a part."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    parts = F.filter(F.transform(F.split(F.coalesce(evidence, F.lit("")), r"\.{3,}|…+"), plain), lambda p: F.length(p) >= least)
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(plain(F.coalesce(text, F.lit(""))), p))


def summary_like(text: Column, least: int = 15, never: str = "chapters") -> Column:
    """A summary, not a broken answer: long enough, without the field name `never`, and no opening bracket first."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= least) & ~F.contains(t, F.lit(never)) & ~F.startswith(t, F.lit("{")) & ~F.startswith(t, F.lit("["))


def placeholder(name: Column, words: list[str]) -> Column:
    """A name that is none: shorter than two characters, or with one of the words."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) < 2) | F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(n, w))


def question(text: Column, phrases: list[str], begins: list[str], most: int = 60) -> Column:
    """Asks for advice: has a phrase, begins with a word, or ends in a question mark within `most` characters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    any_of = lambda test, words: F.exists(F.array(*map(F.lit, words)), lambda w: test(t, w))
    return any_of(F.contains, phrases) | any_of(F.startswith, begins) | (t.rlike("[?？]$") & (F.length(t) <= most))


def state_of(status: Column, last_seen: Column, now: Column, known: list[str], gap: int = 30) -> Column:
    """The status, alive for unknown ones; one that is alive is dormant if last seen more than `gap` before."""
    own = F.when(status.isin(*known), status).otherwise("alive")
    return F.when((own == "alive") & (last_seen < F.greatest(now - max(1, gap), F.lit(0))), "dormant").otherwise(own)
