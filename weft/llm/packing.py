"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

A gene is a whole bin. Crossover injects well-filled bins of one parent into the other, removes bins that hold an
injected document, and best-fits the displaced documents. Pieces are dealt at random into blocks of a bounded
number of pieces; each block is evolved by several islands with their own random orders, and after each epoch an
island passes its best packing to the next one, where it breeds. The fullest packing of a block is kept. The least
filled bin of each block is opened again and packed together with those of 63 other blocks.

Blocks are bounded whatever the data are, so no group grows with the input; all state between epochs is four
numbers a piece and island. Random numbers are seeded by block, island and epoch: a task that is run again packs
the same.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

Packing = list[list[int]]


def fills(bins: Packing, lengths: list[int]) -> list[int]:
    return [sum(map(lengths.__getitem__, b)) for b in bins]


def best_fit(order: list[int], lengths: list[int], bins: Packing, capacity: int) -> Packing:
    """Puts each item of `order` into the bin with the least room that holds it, or into a new one.

    Rooms in use are bits of one integer, so that the best bin is the lowest bit at or above the item's length.
    """
    at: dict[int, list[int]] = {}
    mask = 0
    for b, fill in enumerate(fills(bins, lengths)):
        room = capacity - fill
        at.setdefault(room, []).append(b)
        mask |= 1 << room
    for i in order:
        n = lengths[i]
        if fits := mask >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        at.setdefault(room - n, []).append(b)
        mask |= 1 << (room - n)
    return bins


def fitness(bins: Packing, lengths: list[int]) -> tuple[int, int]:
    """Smaller is better: bins, then the less even fill (sum of squares)."""
    return len(bins), -sum(n * n for n in fills(bins, lengths))


def crossover(into: Packing, giver: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """A child of `into` with a random run of the giver's fullest bins, displaced items best-fitted by falling length."""
    full = fills(giver, lengths)
    fullest = [giver[b] for b in sorted(range(len(giver)), key=lambda b: -full[b])[: max(1, len(giver) // 2)]]
    first = rng.randrange(len(fullest))
    injected = fullest[first : first + max(1, len(fullest) // 3)]
    taken = {i for b in injected for i in b}
    kept, broken = [], []
    for b in into:
        (kept if taken.isdisjoint(b) else broken).append(b)
    displaced = sorted((i for b in broken for i in b if i not in taken), key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, [list(b) for b in kept + injected], capacity)


def mutate(bins: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empties the two least filled bins and a few others and best-fits their items in a slightly shuffled order.

    `bins` are a packing of its own, whose lists are used again.
    """
    full = fills(bins, lengths)
    ranked = sorted(range(len(bins)), key=full.__getitem__)
    gone = {*ranked[:2], *rng.sample(ranked[2:], min(len(ranked[2:]), 3))}
    loose = sorted((i for b in sorted(gone) for i in bins[b]), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.2))
    return best_fit(loose, lengths, [members for b, members in enumerate(bins) if b not in gone], capacity)


def evolve(lengths: list[int], capacity: int, seeds: list[Packing], population: int, generations: int, seed: int) -> Packing:
    """The best packing found: seeds and best fits in random orders, then a child of two of them in each generation.

    Ends early at the lower bound ceil(sum / capacity), where no packing has fewer bins.
    """
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    made = list(seeds)
    while len(made) < population:
        made.append(best_fit(rng.sample(range(len(lengths)), len(lengths)), lengths, [], capacity))
    herd = sorted(((fitness(x, lengths), x) for x in made), key=lambda x: x[0])
    for _ in range(generations):
        if len(herd[0][1]) <= least or len(herd) < 2:
            break
        (_, a), (_, b) = rng.sample(herd, 2)
        child = mutate(crossover(a, b, lengths, capacity, rng), lengths, capacity, rng)
        herd = sorted([*herd, (fitness(child, lengths), child)], key=lambda x: x[0])[:population]
    return herd[0][1]


def _solution(bins: np.ndarray) -> Packing:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(bins.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _numbered(bins: Packing, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int64)
    for b, members in enumerate(bins):
        out[members] = b
    return out


def pack(items: DataFrame, capacity: int = 4096, block_items: int = 2000, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 20) -> DataFrame:
    """uid, sequence_id, offset for each row of items (uid long, unique; length int in 1..capacity).

    items is read several times: pass a stored table. Rows of the full capacity are sequences of their own. No item
    is dropped or cut; sums of lengths in a sequence are at most the capacity, and offsets are gapless from 0. An
    empty table gives an empty one; lengths outside 1..capacity raise. Blocks are dealt by uid, so another numbering
    of the rows gives another packing of much the same number of sequences.
    """
    spark = items.sparkSession
    n, low, high = items.agg(F.count(F.when(F.col("length") < capacity, 1)), F.min("length"), F.max("length")).first()
    if high is not None and not (1 <= low and high <= capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}; found {low} to {high}")
    blocks = max(1, -(-n // block_items))
    full = items.where(F.col("length") == capacity).select("uid", (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = items.where(F.col("length") < capacity).select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    state = small.select("*", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"), F.lit(None).cast("long").alias("bin"), F.lit(0).alias("origin"))

    def epoch_of(epoch: int):
        def island(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own = rows[rows.origin == 0].sort_values("uid")
            lengths = own.length.tolist()
            seeds = [_solution(x.sort_values("uid").bin.to_numpy()) for _, x in rows.groupby("origin")] if epoch else []
            best = evolve(lengths, capacity, seeds, population, generations, hash((int(key[0]), int(key[1]), epoch)))
            return own.assign(bin=_numbered(best, len(own)), origin=0)

        return island

    held: list[DataFrame] = []
    for epoch in range(epochs):
        if epoch:
            state = state.unionByName(state.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(islands)), "origin": F.lit(1)}))
        state = common.stored(state.groupBy("block", "island").applyInPandas(epoch_of(epoch), state.schema), "pack-epoch")
        common.discard(*held)
        held = [state]

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "uid"])
        return rows.assign(offset=rows.groupby("bin").length.cumsum() - rows.length)

    def elite(rows: pd.DataFrame) -> pd.DataFrame:
        best = rows[rows.island == rows.groupby("island").bin.nunique().idxmin()]
        fill = best.groupby("bin").length.sum()
        return placed(best).assign(open=lambda x: (x.bin == fill.idxmin()) & (fill.min() < capacity))[["block", "uid", "length", "bin", "offset", "open"]]

    chosen = common.stored(state.groupBy("block").applyInPandas(elite, "block long, uid long, length int, bin long, offset long, open boolean"), "pack-elite")

    common.discard(*held)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        lengths = rows.length.tolist()
        best = evolve(lengths, capacity, [_solution((rows.block * 2**24 + rows.bin).to_numpy())], population, generations, int(rows.joint.iloc[0]))
        return placed(rows.assign(bin=_numbered(best, len(rows))))[["joint", "uid", "bin", "offset"]]

    joint = chosen.where("open").withColumn("joint", F.floor(F.col("block") / 64)).select("joint", "block", "uid", "length", "bin")
    joint = joint.groupBy("joint").applyInPandas(merged, "joint long, uid long, bin long, offset long")
    number = lambda block, kind: (F.shiftleft(block, 24) + F.col("bin")) * 4 + kind
    return full.unionByName(chosen.where("not open").select("uid", number(F.col("block"), 1).alias("sequence_id"), "offset")).unionByName(joint.select("uid", number(F.col("joint"), 2).alias("sequence_id"), "offset"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of each piece of each document's ids with end_id behind them.

    A null text counts as empty: one piece of length 1. Equal rows are separate documents. uid numbers the rows of
    each input partition and is only stable in a stored table. Other columns of docs are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = common.encoder(tokenizer), np.uint32(end_id).tobytes()
        uid, step = TaskContext.get().partitionId() << 33, 4 * capacity
        for frame in common.sliced(frames):
            out = []
            for doc_id, ids in zip(frame.doc_id, encode(frame.text), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((uid, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            yield pd.DataFrame(out, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "uid long, doc_id long, piece int, start long, length int, ids_crc32 long")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (see token_pieces and pack).

    Null and empty texts are a piece of one id; null doc_ids stay null; repeated rows are packed as often as they are
    there. An empty table gives an empty one. Other columns are not read.
    """
    pieces = common.stored(token_pieces(docs, tokenizer or common.vocabulary(), capacity), "pack-pieces")
    return pieces.join(pack(pieces, capacity), "uid").select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed_documents of all documents."""
    return packed_documents(common.documents(spark, sf_dir))
