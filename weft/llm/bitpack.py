"""Token ids in a fixed number of bits, in blocks with offsets.

A file is a Parquet table of blocks. A block holds whole documents: `ids` are all their ids, each in `width` bits
(the fewest that hold the vocabulary), packed by numpy without gaps; `doc_ids` and `offsets` name the documents and
where each begins. So a document is found by its block and offset, and its ids start at bit offset * width: any of
them can be unpacked without those before it. Blocks end with the document that reaches `block_ids`; only a single
longer document makes a longer block.

Files are in ascending doc_id order by a range partitioning, whose partitions are written side by side; the ids
before a partition are the prefix sum of the partitions' totals, a row for each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import common

BLOCK_IDS = 1 << 18


def width_of(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below vocabulary_size."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids, each in `width` (1 to 32) bits, the lowest bit first; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, start: int, count: int) -> np.ndarray:
    """`count` ids from the id at `start` on; reads only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, start * (width // 8)).astype("<u4")
    first, last = start * width // 8, -(-(start + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")
    bits = bits[start * width - first * 8 :][: count * width].reshape(count, width)
    out = np.zeros((count, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


SCHEMA = "part int, block int, start long, n_ids long, width int, doc_ids array<long>, offsets array<long>, ids binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, vocabulary_size: int, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every text, end_id behind each, in ascending doc_id order (nulls first).

    A null text has the end id only. Rows with equal doc_id follow each other in the order of a hash. Other columns are not
    read. start is the ids of the part before the block. An empty table writes no block.
    """
    width = width_of(vocabulary_size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = common.encoder(tokenizer), np.uint32(end_id).tobytes()
        part, block, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        offsets: list[int] = []
        data: list[bytes] = []
        held = 0

        def done() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(data), "<u4")
            return pd.DataFrame([(part, block, start, held, width, names, offsets, pack_bits(ids, width))], columns=[x.split()[0] for x in SCHEMA.split(", ")])

        for frame in common.sliced(frames, 500):
            for doc_id, ids in zip(frame.doc_id, encode(frame.text), strict=True):
                names.append(None if pd.isna(doc_id) else int(doc_id))
                offsets.append(held)
                data.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= block_ids:
                    yield done()
                    block, start, held, names, offsets, data = block + 1, start + held, 0, [], [], []
        if held:
            yield done()

    # rows of one doc_id (or of none) are split by a hash of their texts, so that no id is in one task
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(common.fanout(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    with common.writing(docs.sparkSession):
        ordered.mapInPandas(run, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file, with `base`, the ids of all blocks of all parts before.

    Parts are the writer's partitions, a row for each, and are broadcast: the blocks' bytes are not shuffled.
    """
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(F.broadcast(parts.select("part", before.alias("__before"))), "part").withColumn("base", F.col("__before") + F.col("start")).drop("__before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of every document of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames, 1):
            for doc_id, start, ids in _documents(frame):
                yield pd.DataFrame([(doc_id, start, len(ids), ids.astype(np.int32))], columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    return read_ids(spark, path).mapInPandas(run, "doc_id long, start long, n_tokens long, ids array<int>")


def _documents(frame: pd.DataFrame) -> Iterator[tuple]:
    for row in frame.itertuples(index=False):
        ends = [*row.offsets[1:], row.n_ids]
        for doc_id, at, end in zip(row.doc_ids, row.offsets, ends, strict=True):
            yield None if pd.isna(doc_id) else int(doc_id), row.base + at, unpack_bits(row.ids, row.width, int(at), int(end - at))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of unsigned little-endian 32-bit ids) of every document of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames, 4):
            out = [(doc_id, start, len(ids), zlib.crc32(ids.tobytes())) for doc_id, start, ids in _documents(frame)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return read_ids(spark, path).select("base", "n_ids", "width", "doc_ids", "offsets", "ids").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_ids(docs: DataFrame, tokenizer: str | None = None, vocabulary_size: int | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs by write_ids into the shared folder and returns document_digests of what was written.

    The vocabulary's size is that of the tokenizer's file, unless given. Repeated rows and null doc_ids (which come
    first) are documents like others; null and empty texts have the end id only. An empty table gives an empty one.
    """
    path, tokenizer = common.fresh_path(docs.sparkSession, "ids"), tokenizer or common.vocabulary()
    write_ids(docs, path, tokenizer, vocabulary_size or common.vocabulary_size(tokenizer), end_id)
    return document_digests(docs.sparkSession, path)


def op9_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed_ids of all documents."""
    return packed_ids(common.documents(spark, sf_dir))
