"""Token counts by a separator scan over flat, unindexed token files.

A token file is the ids of documents, the end-of-document id behind each, without any index. It is kept as a Parquet
table of blocks of a fixed number of ids (file, block, ids: binary), which cut documents anywhere; plain binary
files can be cut into such blocks too (flat_blocks). A block is scanned by itself: one vectorised comparison finds
the separators. What a block can't know is where it and its first document begin. That is a prefix scan over a row
for each block: the running sum of ids, the running count of separators, and the running maximum of their places.

The scan is one pass over the ids without a shuffle of them; the prefix scan is a window for each file over its
blocks' rows. Documents that span blocks, however many, need nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import common

BLOCK_IDS = 1 << 17


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Writes a token file for each partition of docs: file, block, ids (16-bit numbers). Beside these, for a later
    look-up only, ordinal and doc_ids: the names of the documents that were begun, from that ordinal of the file on.

    Special tokens' names in a text are ordinary text, so end_id, a special one below 65536, is nowhere in it. A null
    text is an empty document. Other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = common.encoder(tokenizer, special_as_text=True), np.uint16(end_id).tobytes()
        file, block, ordinal, size = TaskContext.get().partitionId(), 0, 0, 2 * block_ids
        left = bytearray()
        names: list = []

        def rows(last: bool) -> Iterator[tuple]:
            nonlocal block, ordinal, names
            while len(left) >= size or last and left:
                yield file, block, bytes(left[:size]), ordinal, names
                del left[:size]
                block, ordinal, names = block + 1, ordinal + len(names), []

        columns = ["file", "block", "ids", "ordinal", "doc_ids"]
        for frame in common.sliced(frames, 500):
            for doc_id, ids in zip(frame.doc_id, encode(frame.text), strict=True):
                names.append(None if pd.isna(doc_id) else int(doc_id))
                left += np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end
                if len(left) >= size:
                    yield pd.DataFrame(list(rows(False)), columns=columns)
        if left:
            yield pd.DataFrame(list(rows(True)), columns=columns)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "file int, block long, ids binary, ordinal long, doc_ids array<long>")
    with common.writing(docs.sparkSession):
        made.write.option("parquet.block.size", 16 << 20).parquet(path)  # blocks are large: a row group of 32 of them is enough


#: Bytes up to which a plain file is read by one task.
WHOLE_BYTES = 256 << 20


def flat_blocks(spark: SparkSession, path: str, id_bytes: int = 2, block_ids: int = BLOCK_IDS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """file (string), block, ids of plain binary token files of any size.

    A file of at most whole_bytes is read by one task. A longer one is read by many, as records of equal length: the
    largest number of ids up to block_ids that divides the file's. A length that is no multiple of id_bytes raises.
    """
    size = id_bytes * block_ids
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    if ragged := files.select("path").where(F.col("length") % id_bytes != 0).first():
        raise ValueError(f"{ragged.path} does not hold whole ids")
    short = files.where(F.col("length") <= whole_bytes)
    cut = short.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    blocks = cut.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("ids"))
    for row in files.where(F.col("length") > whole_bytes).select("path", "length").collect():  # names of the few long files
        ids = row.length // id_bytes
        each = next(n for n in range(min(block_ids, ids), 0, -1) if ids % n == 0)
        records = spark.sparkContext.binaryRecords(row.path, each * id_bytes).zipWithIndex()
        blocks = blocks.unionByName(spark.createDataFrame(records.map(lambda x, file=row.path: (file, x[1], bytearray(x[0]))), "file string, block long, ids binary"))
    return blocks


def count_tokens(blocks: DataFrame, end_id: int, id_bytes: int = 2) -> DataFrame:
    """file, ordinal (from 0), start (ids of the file before), n_tokens (without the separator) of each document.

    blocks: file, block (ascending along the file), ids. Ids behind a file's last separator are a document without
    an end: it is returned with `ended` false. An empty document has n_tokens 0; an empty table gives an empty one.
    """
    kind = f"<u{id_bytes}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.forget_words()
        for frame in common.sliced(frames, 8):
            out = []
            for row in frame.itertuples(index=False):
                ids = np.frombuffer(row.ids, kind)
                out.append((row.file, row.block, len(ids), np.flatnonzero(ids == end_id)))
            yield pd.DataFrame(out, columns=["file", "block", "n_ids", "ends"])

    file_type = dict(blocks.dtypes)["file"]
    scanned = common.stored(blocks.select("file", F.col("block").cast("long"), "ids").mapInPandas(run, f"file {file_type}, block long, n_ids long, ends array<long>"), "token-scan")
    row = scanned.select("file", "block", "n_ids", F.size("ends").cast("long").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = row.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    base = base.withColumns({"ended": F.coalesce(F.sum("n_ends").over(before), F.lit(0)), "open": F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0))})
    found = scanned.join(base.select("file", "block", "base", "ended", "open"), ["file", "block"])
    begins = F.concat(F.array("open"), F.transform("ends", lambda e: F.col("base") + e + 1))  # of the documents that end here, and of the next
    ends = found.select("file", "ended", F.posexplode(F.arrays_zip(F.transform("ends", lambda e: F.col("base") + e).alias("end"), F.slice(begins, 1, F.size("ends")).alias("start"))).alias("at", "x"))
    closed = ends.select("file", (F.col("ended") + F.col("at")).alias("ordinal"), F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = row.groupBy("file").agg(F.sum("n_ids").alias("all"), F.sum("n_ends").alias("ordinal"))
    tail = base.groupBy("file").agg(F.max(F.greatest("open", F.coalesce(F.col("base") + F.col("last") + 1, F.lit(0)))).alias("start"))
    rest = whole.join(tail, "file").where("start < all").select("file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionByName(rest)


def document_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 49_407) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of every row of docs: its ids written to flat files and counted there.

    Repeated rows and null doc_ids are documents like others; null and empty texts have n_tokens 0. An empty table gives
    an empty one. Other columns are not read.
    """
    path = common.fresh_path(docs.sparkSession, "flat-ids")
    write_flat(docs, path, tokenizer or common.vocabulary(), end_id)
    files = docs.sparkSession.read.parquet(path)
    counted = count_tokens(files.select("file", "block", "ids"), end_id)
    names = files.select("file", "ordinal", F.posexplode("doc_ids").alias("at", "doc_id")).select("file", (F.col("ordinal") + F.col("at")).alias("ordinal"), "doc_id")
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_tokens of all documents."""
    return document_tokens(common.documents(spark, sf_dir))
