"""Whitening of embeddings by singular value decompositions that are merged in a tree.

A task decomposes its centred vectors, batch by batch: what it keeps are its number of vectors, their mean, and all
singular values and right vectors (scaled by the values, a square of the dimension at most). Two such states are merged by
stacking their scaled vectors with one more row, the difference of their means times sqrt(n1 n2 / (n1 + n2)), and
decomposing the stack again. No dimension is cut off, so the result is the decomposition of all vectors, whatever the
order; products of vectors, which would lose half of the digits, are never formed. States of `fan_in` tasks are merged by
one task, round by round; the driver reads the last one, whose size is the dimension's square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

#: Of x = floor(1024 c) + 100000; the decompositions work on x less the shift, whose numbers are small and exact.
SCALE, SHIFT = 1024, 100_000
#: Entries of a larger size are not exact as doubles any more.
LARGEST = 2**52

State = tuple[int, np.ndarray, np.ndarray]  # vectors, their mean, singular values times right vectors


def state_of(x: np.ndarray) -> State:
    """The state of some vectors, a row each."""
    mean = x.mean(axis=0)
    mean += (x - mean).mean(axis=0)  # what rounding left of it
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    return len(x), mean, s[:, None] * v


def merged(a: State, b: State) -> State:
    """The state of the vectors of both."""
    n, gap = a[0] + b[0], b[1] - a[1]
    _, s, v = np.linalg.svd(np.vstack([a[2], b[2], np.sqrt(a[0] * (b[0] / n)) * gap]), full_matrices=False)
    return n, a[1] + gap * (b[0] / n), s[:, None] * v


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists in column: the places of those without nulls and non-finite entries, and these as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    begins = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        x = flat[begins[at][:, None] + np.arange(n)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], x[good]


STATE = "dim int, task long, n long, mean array<double>, basis array<double>, sums array<long>"


def _state_row(dim: int, task: int, state: State, sums: np.ndarray) -> tuple:
    return dim, task, state[0], state[1].tolist(), state[2].ravel().tolist(), sums.tolist()


def _as_integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 c) as doubles, which hold it exactly."""
    y = np.floor(x * SCALE)
    if np.abs(y).max() > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST / SCALE:.0f} and has no exact whole number")
    return y


def decomposed(rows: DataFrame, column: str, scaled: bool, fan_in: int = 16) -> tuple[State, list[int]] | None:
    """The state of all usable vectors of a column of arrays, and (if scaled) the exact sums of floor(1024 c); None without any.

    Null vectors and those with null or non-finite entries are left out, and so are all but those of the commonest length
    (of equally common ones the longest). Repeated vectors count as often as they are there.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple[State, np.ndarray]] = {}
        for batch in batches:
            for _, x in usable(batch.column(0)):
                y = _as_integers(x) if scaled else x
                new = state_of(y), y.astype(np.int64).sum(axis=0) if scaled else np.zeros(0, np.int64)
                old = states.get(x.shape[1])
                states[x.shape[1]] = (merged(old[0], new[0]), old[1] + new[1]) if old else new
        if states:
            task = TaskContext.get().partitionId()
            out = [_state_row(dim, task, *s) for dim, s in states.items()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in STATE.split(", ")])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        state, sums = None, 0
        for n, mean, basis, own in zip(rows.n, rows["mean"], rows.basis, rows.sums, strict=True):
            new = int(n), np.asarray(mean), np.asarray(basis).reshape(-1, int(key[0]))
            state, sums = merged(state, new) if state else new, sums + np.asarray(own, np.int64)
        return pd.DataFrame([_state_row(int(key[0]), int(key[1]), state, sums)], columns=[x.split()[0] for x in STATE.split(", ")])

    states = common.stored(rows.select(column).mapInArrow(first, STATE), "svd-states")
    while (last := states.agg(F.max("task")).first()[0]) is not None and last > 0:
        up = states.withColumn("task", F.floor(F.col("task") / fan_in))
        below, states = states, common.stored(up.groupBy("dim", "task").applyInPandas(merge, STATE), "svd-states")
        common.discard(below)
    best = states.orderBy(F.col("n").desc(), F.col("dim").desc()).first()  # a row for each length
    common.discard(states)
    if best is None:
        return None
    return (best.n, np.array(best["mean"]), np.array(best.basis).reshape(-1, best.dim)), best.sums


def components_of(state: State, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors of the covariance (a row each, the entry of the largest size positive), eigenvalues, trace.

    Directions without variance to working precision are no components.
    """
    n, _, basis = state
    _, s, v = np.linalg.svd(basis, full_matrices=False)
    e = s * s / n
    real = s > s.max(initial=0) * max(basis.shape) * np.finfo(float).eps
    v, kept = v[real][:most], e[real][:most]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    return v, kept, float(e.sum())


def _deviations(y: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum of (n y - sums)^2 for each row, null beyond a long."""
    whole = y.astype(np.int64)
    widest = int(np.abs(whole).max()) * n + int(np.abs(sums).max())
    if widest < 2**62 and widest * widest * y.shape[1] < 2**63:
        d = n * whole - sums
        return (d * d).sum(axis=1).tolist()
    each = [sum((n * a - b) ** 2 for a, b in zip(r, sums.tolist(), strict=True)) for r in whole.tolist()]
    return [d if d < 2**63 else None for d in each]


def whitened(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each usable vector and component.

    x = floor(1024 c) + 100000 of each entry c; components are those of x's covariance over all usable vectors (see
    decomposed), by falling variance; deviation is the sum of (n x - S)^2 with S the sums of x, null where it exceeds a
    long. identity_error comes from a second decomposition, that of the whitened vectors. Null ids stay null, repeated rows
    stay, other columns are not read. Vectors that all are the same have no component, and give no rows, nor does an empty
    table. Entries beyond 2^42 raise, as their whole numbers are not exact.
    """
    schema = "vec_id long, deviation long, whitened array<double>"
    slim = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    found = decomposed(slim, "vector", scaled=True)
    empty = slim.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if found is None:
        return empty
    (n, mean, basis), sums = found
    vectors, variances, trace = components_of((n, mean, basis), most)
    if not len(vectors):
        return empty
    sums, dim = np.array(sums), len(mean)
    across = vectors.T / np.sqrt(variances)
    center = np.array([s / n for s in sums.tolist()])  # the mean from exact sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in usable(batch.column("vector")):
                if x.shape[1] != dim:
                    continue
                y = _as_integers(x)
                w = (y - center) @ across
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(_deviations(y, n, sums), pa.int64()), flat], ["vec_id", "deviation", "whitened"])

    done = common.stored(slim.mapInArrow(project, schema), "whitened")
    (m, _, again), _ = decomposed(done, "whitened", scaled=False)
    error = float(np.abs(again.T @ again / m - np.eye(len(vectors))).max())
    explained = F.element_at(F.lit((variances / trace).tolist()), F.col("component"))
    each = done.select("vec_id", F.posexplode("whitened").alias("component", "whitened"), "deviation").withColumn("component", F.col("component") + 1)
    return each.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitened of all embeddings."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
