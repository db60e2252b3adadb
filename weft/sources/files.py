"""A corpus of files, one folder for each book and one numbered file for each chapter, as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_bytes(raw: bytes) -> tuple[str, str]:
    """The encoding (bom, utf-8, gb18030 or unknown) and the text: UTF-8, or else GB18030 without what does not decode."""
    kind, text = "unknown", None
    for name in ("utf-8", "gb18030"):
        try:
            kind, text = name, raw.decode(name)
            break
        except UnicodeDecodeError:
            continue
    if text is None:
        text = raw.decode("gb18030", "ignore")
    if raw.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        kind, text = "bom", text.removeprefix("\ufeff")
    return kind, text


@F.pandas_udf(StructType().add("encoding", "string").add("text", "string"))
def _text(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_bytes(x) for x in raw], columns=["encoding", "text"])


def chapters(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """book, no, title, path, size, encoding, text of files `path`/<book>/<no>_<title>.txt; unnumbered ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    parts = F.split("path", "/")
    name = F.url_decode(F.replace(F.element_at(parts, -1), F.lit("+"), F.lit("%2B")))
    rows = files.select(F.element_at(parts, -2).alias("book"), F.regexp_extract(name, r"^0*(\d+)", 1).try_cast("int").alias("no"), F.regexp_extract(name, r"^\d+[_ ]*(.*)\.txt$", 1).alias("title"), "path", F.col("length").alias("size"), _text("content").alias("t"))
    rows = rows.where("no is not null")
    if skip:
        rows = rows.where(~F.col("book").isin(*skip))
    return rows.select("book", "no", "title", "path", "size", "t.encoding", "t.text")


def inventory(files: DataFrame) -> DataFrame:
    """For each book: files, bytes, characters, smallest and largest number, missing numbers, files that are not UTF-8."""
    return files.groupBy("book").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(F.length("text")).alias("chars"), F.min("no").alias("first"), F.max("no").alias("last"), (F.max("no") - F.min("no") + 1 - F.count_distinct("no")).alias("missing"), F.count_if(F.col("encoding") != "utf-8").alias("not_utf8"))


def write_report(rows: DataFrame, path: str, group: str, order: str, line: str) -> None:
    """Markdown files: a heading for each group, its lines below in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: F.concat(F.lit("- "), x[line]))
    rows.groupBy(group).agg(parts.alias("p")).select(F.concat(F.lit("## "), F.col(group).cast("string"), F.lit("\n\n"), F.array_join("p", "\n"), F.lit("\n")).alias("value")).write.text(path)


def append_ledger(actions: DataFrame, path: str) -> None:
    """Adds rows (with the time of writing) to an append-only ledger."""
    actions.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def reconciled(now: DataFrame, ledger: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value now differs from the ledger's last one, or that only one side has: key, now, last, state."""
    from weft.operators import aggregates

    last = aggregates.latest(ledger.select(key, "written_at", value), [key], ["written_at"]).select(key, F.col(value).alias("last"))
    both = now.select(key, F.col(value).alias("now"), F.lit(True).alias("__n")).join(last.withColumn("__l", F.lit(True)), key, "full")
    state = F.when(F.col("__l").isNull(), "not_in_ledger").when(F.col("__n").isNull(), "gone").when(~F.col("now").eqNullSafe(F.col("last")), "changed")
    return both.withColumn("state", state).where("state is not null").select(key, "now", "last", "state")
