"""What several operators share: durable intermediate tables, word-cached token encoding, two-level prefix sums."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.storage import WRITING, discard, fresh_path, shared_dir, stored, writing  # noqa: F401  what operators call common.*

#: The six ASCII white-space bytes that separate words: space and 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def spare(df: DataFrame, name: str) -> str:
    """`name`, or `name` with a number behind it, that no column of df has (in any case)."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}{i}" for i in range(2, len(taken) + 3))) if x.lower() not in taken)


def fanout(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def prefix_sum(df: DataFrame, size: str, out: str, group: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Adds `out`, the exclusive running sum of `size` within `group`, without putting a group into one task.

    `bucket` is an integer that never decreases along `order` within a group (equal values: ordered by `order`).
    Sums per (group, bucket) are prefix-summed first, then rows are summed within their bucket; so a hot group
    costs one task no more than its number of buckets plus the rows of one bucket. df is evaluated twice.
    """
    cut = df.withColumns({"__group": F.struct(*group), "__bucket": bucket})  # a struct is equal to itself even with nulls inside
    start, own = Window.unboundedPreceding, ["__group", "__bucket"]
    sums = cut.groupBy(*own).agg(F.sum(size).alias("__sum"))
    base = sums.select(*own, F.coalesce(F.sum("__sum").over(Window.partitionBy("__group").orderBy("__bucket").rowsBetween(start, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy(*own).orderBy(*order).rowsBetween(start, -1)), F.lit(0))
    return cut.withColumn("__inner", inner).join(base, own).withColumn(out, F.col("__base") + F.col("__inner")).drop(*own, "__base", "__inner")


#: Salts of salted_join: a key with a third of all rows is spread over as many tasks.
SALTS = 16


def salted_join(rows: DataFrame, one: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """rows joined with `one`, which has at most a row for each key, so that no key of rows is in one task.

    rows get a salt from `spread`, and `one` is repeated for each salt: pass slim rows, for keys that do repeat only.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    every = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [key, "__salt"], how).drop("__salt")


#: Rows of keys up to which they are broadcast: about 20 MB.
MOST_BROADCAST = 500_000


def few_or_joined(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """A semi or anti join of rows with stored keys, which are broadcast if they are few; else both are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, on, how)


#: An ASCII letter before ASCII punctuation other than the apostrophe: always a border between two pre-tokens.
_BORDER = re.compile(r"([A-Za-z])([!-&(-/:-@\[-`{-~])")
#: Words whose ids one Python worker keeps, and characters of the longest of them.
CACHED_WORDS, CACHED_CHARS = 600_000, 64
#: New words that are encoded as one text.
JOINED_WORDS = 200


class WordEncoder:
    """Whole-text ids of the `word_bpe` vocabulary, the same as `Tokenizer.encode(text, add_special_tokens=False)`.

    That tokenizer drops white space and never joins pre-tokens, so the ids of a text are the ids of its
    blank-separated words in turn. Each distinct word of a batch is encoded once by the tokenizers library, many of them
    as one text, and kept as little-endian unsigned 32-bit bytes; a text is then one bytes.join. Texts with "<|" may hold a special
    token's name, which can span a border, and are cut at blanks and line ends only.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), {"": b""}
        self.tokenizer.encode_special_tokens = special_as_text

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        split = [self._cut(x or "") for x in texts]
        known = self.kept
        new = [w for w in set().union(*split) if w not in known]
        if new:
            if len(known) + len(new) > CACHED_WORDS:
                known = dict(known)  # full: these words serve this batch only
            plain = [w for w in new if w.isprintable() and "<" not in w]
            known.update(zip(plain, self._together(plain), strict=True))
            odd = [w for w in new if w not in known]
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words without blanks: of many in one text, cut where each word begins."""
        parts = [words[at : at + JOINED_WORDS] for at in range(0, len(words), JOINED_WORDS)]
        out: list[bytes] = []
        for part, e in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            data = array("I", e.ids).tobytes()
            begins = np.fromiter((begin for begin, _ in e.offsets), np.int64, len(data) // 4)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            at = 0
            for cut in (4 * np.searchsorted(begins, ends)).tolist():
                out.append(data[at:cut])
                at = cut
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        return (text if "<|" in text else _BORDER.sub(r"\1 \2", text)).replace("\n", " ").split(" ")


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One per Python worker, so that a word's ids are kept from task to task."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def forget_words() -> None:
    """Drops this worker's tokenizers and their words: Spark uses workers again, and other work needs the memory."""
    _encoders.clear()


def sliced(frames: Iterator, rows: int = 2000) -> Iterator:
    """Batches of at most `rows` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer's file, special ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
