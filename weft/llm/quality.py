"""Quality rules: isolation forest on rule statistics, thresholds calibrated from labelled rows.

Each text gives counts (words, symbols, repeated lines, repeated windows); ratios of these are the forest's features.
The forest is fitted on good labelled rows: each tree splits a few hundred of them at random until they are alone.
Split values are drawn over the range that all documents have, cut down on the way: a document unlike the good ones
soon falls into a part where none of them is. Its score is 2^(-mean path / mean path of the sample size). The
threshold is the score that parts the two labels best on other labelled rows, with at most a set share of the good
ones beyond it.

Counts are over whole texts of all documents and are stored once. The forest is fitted on a bounded sample of labelled
rows (FIT_ROWS, those with the smallest hash of doc_id); the threshold is from all other labelled rows, by counts of
(rounded score, label). All rows are then scored by a vectorised function to which the forest (TREES * 2 * SAMPLE nodes
at most) is passed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

TREES, SAMPLE = 100, 256
#: Labelled good rows that the forest is fitted on at most.
FIT_ROWS = 8192
#: The share of good labelled rows that the threshold may reject.
GOOD_LOSS = 0.001
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "repeat_share", "dup_line_share", "mean_word"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the text, the first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    at = ids[:n]
    for i in range(1, window):  # the number of each different window of 2, 3, ... words
        at = np.unique(at * len(number) + ids[i : i + n], return_inverse=True)[1]
    hits = np.bincount(at)[at] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hits
    edge[window:] -= hits
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple:
    """COUNTS, then lines with a word, of a whole text."""
    data = text.encode()
    words = data.split()  # of bytes: splits at the six ASCII white-space bytes only
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(texts: pd.Series) -> pd.DataFrame:
    """COUNTS, base_failed and FEATURES of whole texts; a null text is empty."""
    out = pd.DataFrame([statistics(x or "") for x in texts], columns=[*COUNTS, "n_lines"], dtype="int64")
    share = lambda a, b: out[a] / out[b].clip(lower=1)
    return out.assign(
        base_failed=(out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words),
        symbol_share=np.sqrt(share("n_symbols", "word_chars")),  # small shares tell as much as large ones
        repeat_share=share("n_repeat_words", "n_words"),
        dup_line_share=share("n_dup_lines", "n_lines"),
        mean_word=np.log1p(share("word_chars", "n_words")),
    ).drop(columns="n_lines")


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct `name` of what is measured of the column text (COUNTS, base_failed, FEATURES)."""
    fields = ", ".join([*(f"{c} long" for c in COUNTS), "base_failed boolean", *(f"{c} double" for c in FEATURES)])

    @F.pandas_udf(fields)
    def measure(texts: pd.Series) -> pd.DataFrame:
        common.forget_words()
        return measured(texts)

    return docs.withColumn(name, measure("text"))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and what is measured of every row. Other columns are not read."""
    return with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "found").select("doc_id", "found.*")


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n rows: what a leaf of n rows would still add."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: a split's feature and value, its first child (the second follows), a leaf's path."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], low, high, rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, low, high, 0)]
        while todo:
            node, own, low, high, depth = todo.pop()
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(own) < 2 or not len(wide):
                path[node] = depth + float(mean_path(len(own)))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            feature[node], value[node], child[node] = f, cut, len(feature)
            edge = np.arange(len(low)) == f
            for side, a, b in ((own[:, f] <= cut, low, np.where(edge, cut, high)), (own[:, f] > cut, np.where(edge, cut, low), high)):
                todo.append((len(feature), own[side], a, b, depth + 1))
                for x, empty in ((feature, -1), (value, 0.0), (child, 0), (path, 0.0)):
                    x.append(empty)
        return np.array(feature), np.array(value), np.array(child), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From near 0 (like the sample) to 1 (alone at once)."""
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                step = child[node] + (rows[at_row, f] > value[node])
                node = np.where(f >= 0, step, node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(float(mean_path(self.sample)), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, loss: float = GOOD_LOSS, rows: np.ndarray | None = None) -> float:
    """The score above which most bad rows and at most `loss` of the good ones are; no bad or no good rows: infinity.

    Of the cuts that reject at most that share of good rows, one with the most rejected bad rows less rejected good
    ones (as shares) is taken, half way to the next score. `rows`: how many rows have each score (one by default).
    """
    rows = np.ones(len(scores)) if rows is None else np.asarray(rows, float)
    if not good.any() or good.all():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, g, n = scores[order], good[order], rows[order]
    lost, caught = np.cumsum(n * g) / n[g].sum(), np.cumsum(n * ~g) / n[~g].sum()
    last = np.append(s[1:] < s[:-1], True)
    gain = np.where(last & (lost <= loss), caught - lost, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return float("inf")
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best]) - 1e-9


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """The forest and the threshold from labels (doc_id, quality: 0 or 1); None without good labelled rows.

    Labels of unknown documents, without a quality, or with two different ones for a document don't count. The forest
    is fitted on a bounded sample of a quarter of the good rows; the threshold is from all other labelled rows.
    """
    one = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    known = stats.where("not base_failed").join(one.drop("other"), "doc_id").select("doc_id", "quality", *FEATURES, F.xxhash64("doc_id", F.lit("fit")).alias("h"))
    known = common.stored(known, "rule-labelled")
    apart = F.pmod("h", F.lit(4)) == 0
    good = known.where(apart & (F.col("quality") == 1)).orderBy("h", "doc_id", *FEATURES).limit(FIT_ROWS).toPandas()  # bounded
    if not len(good):
        return None
    span = stats.agg(*(f(x) for f in (F.min, F.max) for x in FEATURES)).first()
    forest = Forest(good[FEATURES].to_numpy(float), *np.array(span, float).reshape(2, -1))
    other = scored(known.where(~apart), forest).groupBy(F.round("anomaly", 5).alias("score"), "quality").count().toPandas()  # at most 100,000 scores a label
    common.discard(known)
    if not len(other):
        return forest, float("inf")
    return forest, threshold(other.score.to_numpy(float), other.quality.to_numpy() == 1, rows=other["count"].to_numpy())


def anomaly_of(forest: Forest) -> Callable[..., Column]:
    """The forest's score as a function of the FEATURES columns."""

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([x.to_numpy(float) for x in features])))

    return score


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with `anomaly`, the forest's score."""
    return stats.withColumn("anomaly", anomaly_of(forest)(*FEATURES))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, anomaly of every row of docs.

    kept is false for rows that fail the base rules, and for rows whose anomaly is above the threshold. Without good
    labels nothing but the base rules decides, and anomaly is null. Repeated rows, null doc_ids and empty texts are
    rows like others; an empty table gives an empty one.
    """
    stats = common.stored(rule_statistics(docs), "rule-statistics")
    fitted = fit(stats, labels)
    limit = float("inf")
    if fitted is None:
        judged = stats.withColumn("anomaly", F.lit(None).cast("double"))
    else:
        judged, limit = scored(stats, fitted[0]), fitted[1]
    passed: Column = F.coalesce(F.col("anomaly") <= F.lit(limit), F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & passed).alias("kept"), "anomaly")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that verdicts() keeps, with all their columns, whatever their names.

    A verdict depends on the text alone: texts are measured once, and rows with a rejected text go by its digest. Rows
    with a null or empty text fail the base rules; null doc_ids have no label; repeated rows are all kept or none. An
    empty table gives an empty one.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
    stats = common.stored(with_statistics(slim, "found").select("doc_id", "digest", "found.*"), "rule-statistics")
    fitted = fit(stats, labels)
    good = ~F.col("base_failed")
    if fitted is not None:
        good = good & (anomaly_of(fitted[0])(*FEATURES) <= F.lit(fitted[1]))
    name = common.spare(docs, "digest")
    gone = common.stored(stats.where(~good).select(F.col("digest").alias(name)).distinct(), "rule-rejected")
    common.discard(stats)
    return common.few_or_joined(docs.withColumn(name, digest), gone, name, "left_anti").select(*docs.columns)


def op4_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verdicts on all documents, with all labels."""
    return verdicts(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
