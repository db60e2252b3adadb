"""Arcs of a book that is still being read: chapters come in any order, arcs leave when nothing to come can change them.

A chapter (place) may be a cut. Cuts at most `gap` places apart are one cut, the middle one of them; an arc begins at a
cut and ends before the next one, but not before it has `least` places. A group of cuts is complete when `gap` places
behind its last one have come without another, so an arc is settled then, and a book's state is its open arc, the open
group and the places that came before their turn. A missing place is waited for; after `patience` in event time it is
given up: a row tells of it, and another one if it comes after all. Places that come again change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Out = list[tuple[str, int, int]]  # kind (arc, missing, late), lo, hi


class Reader:
    """One book's fold. `next` is the place whose turn it is, from 1 on."""

    def __init__(self, gap: int, least: int, state: str | None = None):
        self.gap, self.least = gap, least
        self.next, self.lo, self.group, self.pending, self.given_up = 1, 1, [], {}, []
        if state:
            self.next, self.lo, self.group, pending, self.given_up = json.loads(state)
            self.pending = {int(k): v for k, v in pending.items()}

    def state(self) -> str:
        return json.dumps([self.next, self.lo, self.group, self.pending, self.given_up])

    def come(self, place: int, cut: bool) -> Out:
        if place in self.given_up:
            self.given_up.remove(place)
            return [("late", place, place)]
        if place >= self.next:
            self.pending.setdefault(place, cut)
        return []

    def read(self) -> Out:
        """Reads on as far as places have come."""
        out: Out = []
        while self.next in self.pending:
            if self.pending.pop(self.next):
                self.group.append(self.next)
            elif self.group and self.next - self.group[-1] >= self.gap:
                out += self._cut()
            self.next += 1
        return out

    def _cut(self) -> Out:
        at, self.group = self.group[len(self.group) // 2], []
        if at - self.lo < self.least:
            return []
        arc = ("arc", self.lo, at - 1)
        self.lo = at
        return [arc]

    def give_up(self) -> Out:
        """Reads on behind the gap before the first place that has come."""
        if not self.pending:
            return []
        first, begin = min(self.pending), self.next
        for p in range(begin, first):
            self.pending[p] = False
            self.given_up.append(p)
        return [("missing", begin, first - 1), *self.read()]

    def end(self) -> Out:
        """The arcs that are left when the book is over."""
        out = []
        while self.pending:
            out += self.give_up()
        out += self._cut() if self.group else []
        return [*out, ("arc", self.lo, self.next - 1)] if self.next > self.lo else out


def _frame(book: object, out: Out) -> pd.DataFrame:
    return pd.DataFrame([(book, *x) for x in out], columns=["book", "kind", "lo", "hi"])


class _Live(StatefulProcessor):
    def __init__(self, gap: int, least: int, patience_ms: int):
        self.gap, self.least, self.patience = gap, least, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("book", "data string")

    def _reader(self) -> Reader:
        return Reader(self.gap, self.least, self.held.get()[0] if self.held.exists() else None)

    def _kept(self, reader: Reader, now: int) -> None:
        self.held.update((reader.state(),))
        if reader.pending and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.patience)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reader, out, now = self._reader(), [], 0
        for frame in rows:
            now = max(now, int(frame["at"].max().timestamp() * 1000))
            for place, cut in zip(frame["place"], frame["cut"], strict=True):
                out += reader.come(int(place), bool(cut))
        out += reader.read()
        self._kept(reader, now)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reader = self._reader()
        out = reader.give_up()
        self._kept(reader, expiredTimerInfo.getExpiryTimeInMs())
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def _schema(places: DataFrame) -> str:
    return f"book {dict(places.dtypes)['book']}, kind string, lo long, hi long"


def live_arcs(places: DataFrame, gap: int, least: int, patience_ms: int = 3_600_000, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """book, kind, lo, hi of a stream of (book, place from 1, cut, a timestamp): arcs as they settle, missing and late places.

    A missing place is given up when the watermark, `late` behind the newest time, is patience_ms beyond the time of a later
    place that came. Needs the RocksDB state store, which keeps timers. The last arc of a book stays open.
    """
    rows = places.select("book", "place", "cut", F.col(at).alias("at")).withWatermark("at", late)
    return rows.groupBy("book").transformWithStateInPandas(_Live(gap, least, patience_ms), _schema(places), "Append", "EventTime")


def arcs_of(places: DataFrame, gap: int, least: int) -> DataFrame:
    """The same of a finished table, with missing places and the last arcs: a book is folded in one task, of slim rows."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        reader = Reader(gap, least)
        for place, cut in zip(frame["place"], frame["cut"], strict=True):
            reader.come(int(place), bool(cut))
        return _frame(frame["book"].iloc[0], [*reader.read(), *reader.end()])

    once = places.where("place >= 1").groupBy("book", "place").agg(F.max("cut").alias("cut"))
    return once.groupBy("book").applyInPandas(step, _schema(places))
