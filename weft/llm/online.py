"""Packing documents online in bounded space: a fixed number of open windows for each task.

A task sees its documents once. A piece goes whole into the open window with the least room that holds it, or into a new
one while fewer than `windows` are open. If none holds it, the fullest window is filled up with the piece's head, emitted
and never touched again, and the rest of the piece is placed in turn: so an emitted window has no padding, and a document
is cut only where the windows offer no place. What a task has in memory are its open windows and one batch of documents.

Its open windows are left over at the end. They keep their ids, so that they can be cut, and are merged: the leftovers of
`fan_in` tasks are packed in the same way by one task, round by round, until one task has the last. This one pours its
emptiest windows into its fullest, and cuts the rest, less than a window, at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

#: doc_id, start (in ids), doc_tokens, the ids as little-endian unsigned 32-bit bytes.
Piece = tuple[int | None, int, int, bytes]
Window = list[Piece]


class OpenWindows:
    """At most `windows` open windows of `capacity` ids."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.most = capacity, windows
        self.rooms: list[tuple[int, int]] = []  # (room in ids, window), ascending
        self.held: dict[int, Window] = {}
        self.opened = 0

    def place(self, piece: Piece) -> Iterator[Window]:
        """Places a piece, and gives the windows that are full or had to be emitted for it."""
        doc_id, start, total, ids = piece
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.rooms, (n, -1))  # the least room that holds it
            if at == len(self.rooms) and (len(self.rooms) < self.most or n >= self.capacity):
                insort(self.rooms, (self.capacity, self.opened))
                self.held[self.opened] = []
                self.opened += 1
                at = len(self.rooms) - 1
            elif at == len(self.rooms):
                at = 0  # none holds it: the fullest
            room, window = self.rooms.pop(at)
            head, ids = ids[: 4 * room], ids[4 * room :]
            self.held[window].append((doc_id, start, total, head))
            start += len(head) // 4
            if room == len(head) // 4:
                yield self.held.pop(window)
            else:
                insort(self.rooms, (room - len(head) // 4, window))

    def leave(self) -> list[Window]:
        """The open windows, the fullest first; none is open any more."""
        out = [self.held[w] for _, w in self.rooms]
        self.rooms, self.held = [], {}
        return out


def poured(leftovers: list[Window], capacity: int) -> Iterator[Window]:
    """The pieces of open windows, the fullest first, as full windows and some of a power of two ids.

    The first windows stay as they are and are filled up with pieces of the last ones.
    """
    rows = [list(w) for w in leftovers]
    size = [sum(len(p[3]) for p in w) // 4 for w in rows]
    lo, hi = 0, len(rows) - 1
    while lo < hi:
        if size[lo] == capacity:
            lo += 1
        elif not rows[hi]:
            hi -= 1
        else:
            doc_id, start, total, ids = rows[hi].pop()
            fits = 4 * (capacity - size[lo])
            rows[lo].append((doc_id, start, total, ids[:fits]))
            if ids[fits:]:
                rows[hi].append((doc_id, start + fits // 4, total, ids[fits:]))
            moved = min(fits, len(ids)) // 4
            size[lo] += moved
            size[hi] -= moved
    yield from (w for w, n in zip(rows, size, strict=True) if n == capacity)
    for w, n in zip(rows, size, strict=True):
        if 0 < n < capacity:  # one at most: cut at its number's binary digits
            loose = list(reversed(w))
            while n:
                room = 1 << n.bit_length() - 1
                n -= room
                part: Window = []
                while room:
                    doc_id, start, total, ids = loose.pop()
                    part.append((doc_id, start, total, ids[: 4 * room]))
                    if ids[4 * room :]:
                        loose.append((doc_id, start + room, total, ids[4 * room :]))
                    room -= min(room, len(ids) // 4)
                yield part


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, ids binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def _rows(windows: Iterable[Window], task: int, number: int, level: int, left: bool) -> pd.DataFrame:
    """A row for each piece; sequences are numbered from `number` on within the task and level; those left over keep ids."""
    out = []
    for w in windows:
        offset, sequence = 0, (task << 28 | number) << 6 | level
        number += 1
        for doc_id, start, total, ids in w:
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, task, ids if left else None))
            offset += len(ids) // 4
    return pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})


def packed_online(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, windows: int = 32, end_id: int = 2, fan_in: int = 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of each document's ids, end_id behind
    them. Every sequence has `capacity` ids, but for the last few, which have powers of two.

    A null text is an empty one: a piece of one id. Null doc_ids stay null. Repeated rows are documents each. Other columns
    are not read. An empty table gives an empty one. Sequences depend on how the input is split into tasks.
    """
    tokenizer = tokenizer or common.vocabulary()

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, task = common.encoder(tokenizer), np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        state, number = OpenWindows(capacity, windows), 0
        for frame in common.sliced(frames, 500):
            done: list[Window] = []
            for doc_id, ids in zip(frame.doc_id, encode(frame.text), strict=True):
                ids += end
                done += state.place((None if pd.isna(doc_id) else int(doc_id), 0, len(ids) // 4, ids))
            yield _rows(done, task, number, 0, False)
            number += len(done)
        yield _rows(state.leave(), task, number, 0, True)

    def merger(level: int, last: bool):
        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            task, state, done = int(key[0]), OpenWindows(capacity, windows), []
            rows = rows.assign(size=rows.groupby("sequence_id").length.transform("sum")).sort_values(["size", "sequence_id", "offset"], ascending=[False, True, True])
            for doc_id, start, total, ids in zip(rows.doc_id, rows.start, rows.doc_tokens, rows.ids, strict=True):
                done += state.place((None if pd.isna(doc_id) else int(doc_id), int(start), int(total), ids))
            left = state.leave()
            if last:
                return _rows([*done, *poured(left, capacity)], task, 0, level, False)
            return pd.concat([_rows(done, task, 0, level, False), _rows(left, task, len(done), level, True)])

        return merge

    rows = common.stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(first, SCHEMA), "online-pieces")
    held, tasks, level = [rows], (rows.agg(F.max("task")).first()[0] or 0) + 1, 0
    while level == 0 or tasks > 1:
        tasks, level = -(-tasks // fan_in), level + 1
        group = F.floor(F.col("task") / fan_in).alias("task")
        open_ = held[-1].where("ids is not null").withColumn("task", group)
        held.append(common.stored(open_.groupBy("task").applyInPandas(merger(level, tasks == 1), SCHEMA), "online-merged"))
    closed = reduce(DataFrame.unionByName, (t.where("ids is null") for t in held))
    return closed.drop("task", "ids")


def op13_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed_online of all documents."""
    return packed_online(common.documents(spark, sf_dir))
