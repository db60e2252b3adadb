"""A stateful guard against streams of text that repeat themselves."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

WINDOW, LEAST, SHARE, SENTENCE, TIMES = 600, 40, 0.55, 12, 3


def overlap(window: str) -> int:
    """The longest end of the last third that begins somewhere in the first two thirds."""
    head, tail = window[: 2 * len(window) // 3], window[2 * len(window) // 3 :]
    low, high = 0, len(tail)
    while low < high:  # a shorter beginning of tail is in head whenever a longer one is
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tail[:mid] in head else (low, mid - 1)
    return low


def fold(window: str, chunk: str) -> tuple[str, bool]:
    """The window after a chunk, and whether the stream is to stop there."""
    window = (window + chunk)[-WINDOW:]
    n = overlap(window)
    if n >= LEAST and n / max(1, len(chunk)) >= SHARE:
        return window, True
    sentences = [s.strip() for s in re.split(r"[.!?。！？\n]", window)]
    return window, any(len(s) >= SENTENCE and sentences.count(s) >= TIMES for s in set(sentences))


def guarded(chunks: DataFrame) -> DataFrame:
    """stream_id, seq, chunk, stopped of a stream of (stream_id, seq, chunk); nothing of a stream after it stopped.

    State for each stream is its last 600 characters, or that it was stopped, and is kept: a stream that stopped never
    starts again. Works on a streaming DataFrame; a micro-batch's chunks of a stream are taken in the order of seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        window, stopped = state.get if state.exists else ("", False)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if stopped:
                break
            window, stopped = fold(window, row.chunk or "")
            out.append((key[0], row.seq, row.chunk, stopped))
        state.update(("" if stopped else window, stopped))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "chunk", "stopped"])

    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, seq long, chunk string, stopped boolean", "window string, stopped boolean", "append", "NoTimeout")


def guarded_batch(chunks: DataFrame) -> DataFrame:
    """The same over a finished table."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        window, out = "", []
        for row in frame.sort_values("seq").itertuples():
            window, stopped = fold(window, row.chunk or "")
            out.append((row.stream_id, row.seq, row.chunk, stopped))
            if stopped:
                break
        return pd.DataFrame(out, columns=["stream_id", "seq", "chunk", "stopped"])

    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.groupBy("stream_id").applyInPandas(step, f"stream_id {kind}, seq long, chunk string, stopped boolean")
