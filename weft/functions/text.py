"""Text measures, clean-up and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

STRING = StringType()
#: A phrase's number, its hits, and where the first one begins.
COUNTED = StructType().add("i", IntegerType()).add("n", IntegerType()).add("first", IntegerType())
#: The same with the line and the context of the first one.
FOUND = StructType([*COUNTED.fields]).add("line_no", IntegerType()).add("context", STRING)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", "")


def fingerprint(text: Column) -> Column:
    """MD5 of the lower-case letters and digits: equal for texts that differ in layout, case and punctuation."""
    return F.md5(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""))


def tokens_trunc(text: Column) -> Column:
    """Estimated tokens, one for 1.5 characters, rounded down."""
    return F.floor(F.length(text) / 1.5)


def tokens_even(text: Column) -> Column:
    """The same, rounded half to even."""
    return F.bround(F.length(text) / 1.5).cast("long")


def tokens_by_chars(chars: Column, share: float = 0.7) -> Column:
    """Estimated tokens of a number of characters; negative counts as none."""
    return F.floor(F.greatest(chars, F.lit(0)) * F.lit(share))


def grams(text: Column, n: int) -> Column:
    """All character n-grams of text, repeats included; none for a shorter text. Linear in its length."""
    places = lambda cs: F.when(F.size(cs) >= n, F.sequence(F.lit(0), F.size(cs) - n)).otherwise(F.array().cast("array<int>"))
    one = lambda cs: F.transform(places(cs), lambda i: F.concat(*(F.get(cs, i + k) for k in range(n))))
    return F.element_at(F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), one), 1)  # binds the characters once


def gram_relevance(text: Column, query: Column, n: int = 2) -> Column:
    """The share of the query's distinct n-grams that text contains; 0 for a query without any."""
    wanted = F.array_distinct(grams(query, n))
    return F.coalesce(F.try_divide(F.size(F.filter(wanted, lambda g: F.contains(text, g))), F.size(wanted)), F.lit(0.0))


def chars(text: Column) -> Column:
    """The distinct characters of text."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays' distinct elements; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def repeated_gram_share(text: Column, n: int) -> Column:
    """1 - distinct / all character n-grams; 0 for shorter texts."""
    all_ = grams(text, n)
    return F.when(F.size(all_) > 0, 1 - F.size(F.array_distinct(all_)) / F.size(all_)).otherwise(0.0)


def paragraphs(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def summary(text: Column, limit: int = 220, least: int = 10) -> Column:
    """The first paragraph of at least `least` characters that is no heading, rule or table, cut to `limit`; else empty."""
    good = F.filter(paragraphs(text), lambda p: (F.length(p) >= least) & ~p.rlike(r"^(#|---|===|\|)"))
    first = F.try_element_at(good, F.lit(1))
    return F.coalesce(F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("…"))).otherwise(first), F.lit(""))


def head_and_tail(text: Column, head: int = 180, tail: int = 160) -> Column:
    """The first two paragraphs up to `head` characters, dots, and the last two up to `tail`."""
    p = paragraphs(text)
    last = F.when(F.size(p) > 2, F.slice(p, -2, 2)).otherwise(p)
    return F.concat(F.substring(F.array_join(F.slice(p, 1, 2), "\n"), 1, head), F.lit("……"), F.substring(F.array_join(last, "\n"), 1, tail))


def joined(parts: Column, cap: int = 500, sep: str = "；") -> Column:
    """Parts in one string, cut to `cap` characters with an ellipsis."""
    text = F.array_join(parts, sep)
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("…"))).otherwise(text)


def name_tags(name: Column, most: int = 8) -> Column:
    """The parts of a file name between delimiters, of two characters or more, distinct, in order."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    return F.slice(F.array_distinct(F.filter(F.split(stem, r"[\s_\-—·,，、.()\[\]#/]+"), lambda t: F.length(t) >= 2)), 1, most)


def masked_key(key: Column) -> Column:
    """A secret's last four characters behind stars; stars alone for four or fewer; empty for blank."""
    k = F.trim(F.coalesce(key, F.lit("")))
    return F.when(k == "", "").when(F.length(k) <= 4, "***").otherwise(F.concat(F.lit("***"), F.right(k, F.lit(4))))


def without_fences(text: Column) -> Column:
    """Text inside a Markdown code fence, if it is fenced."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?|\n?```$", ""))


def longest_first(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, the longest first, so that no name is cut by a shorter one inside it."""
    for old, new in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def snippet(text: Column, markers: list[str], limit: int = 50) -> Column:
    """The first clause that contains a marker, cut to `limit` characters; null if none does."""
    hit = F.filter(F.split(text, r"[.!?;。！？；\n]"), lambda c: F.coalesce(*(F.when(F.contains(c, F.lit(m)), F.lit(True)) for m in markers), F.lit(False)))
    return F.substring(F.trim(F.try_element_at(hit, F.lit(1))), 1, limit)


def without_clauses(text: Column, phrases: list[str]) -> Column:
    """Text without its clauses (up to . ! ? ;) that contain one of the phrases."""
    parts = F.regexp_extract_all(text, F.lit(r"([^.!?;]+[.!?;]?)"), 1)
    bad = lambda c: F.coalesce(*(F.when(F.contains(c, F.lit(p)), F.lit(True)) for p in phrases), F.lit(False))
    return F.array_join(F.filter(parts, lambda c: ~bad(c)), "")


def cut_at_boundary(text: Column, limit: int, marks: tuple[str, ...] = ("\n\n", "\n", "。", ". ", "；", "，"), share: float = 0.6) -> Column:
    """Text cut to `limit` characters, after the last of the first kind of mark that is beyond `share` of the limit."""
    head = F.substring(text, 1, limit)
    ends = [F.length(head) - F.instr(F.reverse(head), m[::-1]) + 1 for m in marks]
    found = [F.when((F.instr(head, m) > 0) & (end > limit * share), F.substring(head, F.lit(1), end)) for m, end in zip(marks, ends, strict=True)]
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(*found, head))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clipped(text: Column, most: int) -> Column:
    """The first `most` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def load_ids(text: Column, name: str = "load") -> Column:
    """The ids of the first command [[name: a, b]] in a text; null without one."""
    body = F.regexp_extract(text, rf"\[\[{name}:([^\]]*)\]\]", 1)
    ids = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.rlike(rf"\[\[{name}:[^\]]*\]\]"), ids)


def without_commands(text: Column, name: str = "load") -> Column:
    """The text without lines that are such commands."""
    return F.regexp_replace(text, rf"(?m)^[ \t]*\[\[{name}:[^\]]*\]\][ \t]*\n?", "")


def without_ascii_words(text: Column) -> Column:
    """The text without ASCII words of two letters or more; blanks are squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[A-Za-z]{2,}", ""), " +", " "))


def beat(label: Column) -> tuple[Column, Column]:
    """The symbol and the number of repeats (1 without one) of a label such as `a×3`."""
    times = F.regexp_extract(label, r"×\s*(\d+)\s*$", 1)
    return F.trim(F.regexp_replace(label, r"×\s*\d+\s*$", "")), F.coalesce(times.try_cast("int"), F.lit(1))


def as_list(text: Column) -> Column:
    """Parts between semicolons (of either width) and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;；\n]"), lambda x: F.trim(x)), lambda x: x != "")


def ideographs(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def behind_stars(line: Column, least: int = 4) -> Column:
    """What follows `least` or more stars at a line's begin; null for other lines."""
    return F.when(line.rlike(rf"^\s*\*{{{least},}}"), F.trim(F.regexp_extract(line, rf"^\s*\*{{{least},}}(.*)$", 1)))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{1,6})", 1).try_cast("int")


def guessed(text: Column, words: dict[str, list[str]]) -> Column:
    """The first key that has one of its words in the text; null for none."""
    out = F.lit(None).cast("string")
    for key, own in reversed(words.items()):
        out = F.when(F.exists(F.array(*map(F.lit, own)), lambda w: F.contains(text, w)), key).otherwise(out)
    return out


def cleaned_list(values: Column, most: int, allowed: list[str] | None = None) -> Column:
    """Trimmed values without blanks and repeats, of the allowed ones if any are named, `most` at most."""
    found = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    if allowed is not None:
        found = F.filter(found, lambda x: x.isin(*allowed))
    return F.slice(found, 1, most)


def made_of(text: Column, words: list[str]) -> Column:
    """Whether nothing is left of a text without the words, the longest first."""
    for w in sorted(words, key=lambda w: (-len(w), w)):
        text = F.replace(text, F.lit(w), F.lit(""))
    return F.trim(text) == ""


def labelled(parts: list[tuple[str, Column]], sep: str = "; ", cap: int | None = None) -> Column:
    """`label: value` of each part whose value isn't null or blank, in order; a part without a label is its value alone. Arrays are
    their elements with commas; a value is cut to `cap` characters with an ellipsis. Empty where nothing is said."""

    def said(label: str, value: Column) -> Column:
        text = F.trim(value)
        text = clipped(text, cap) if cap else text
        return F.when(text != "", F.concat(F.lit(f"{label}: " if label else ""), text))

    return F.array_join(F.array_compact(F.array(*(said(label, value.cast("string")) for label, value in parts))), sep)
