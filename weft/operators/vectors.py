"""Vectors in bulk: first-fit clusters, a bucketed index with an exact mode, packed columns with a quarantine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from weft import storage
from weft.functions import vector as V
from weft.operators import retrieval


def _unit(vectors: list) -> np.ndarray:
    """Rows of length one; zero vectors stay."""
    x = np.array(vectors, float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


NONE = np.iinfo(np.int64).max


def _near_labels(x: np.ndarray, block: np.ndarray, labels: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of x the smallest label of the block's rows that are as near as the threshold; NONE without any."""
    return np.where((x @ block.T).round(6) >= threshold, labels[None, :], NONE).min(axis=1, initial=NONE)


def first_fit(rows: DataFrame, threshold: float = 0.80, against: str = "members", block: int = 2048) -> DataFrame:
    """row_id, cluster: rows in ascending row_id, each in the first cluster in which a member's cosine reaches the threshold,
    or else in a new one. A cluster is named by its first row and clusters are ordered by it.

    against="leaders" compares with clusters' first rows only. The table is gone through in blocks of `block` rows: a block
    is folded by itself, as all rows before it are decided, and then sent to all tasks, where each later row notes the
    smallest cluster that it is near to. So a row carries one number, not its neighbours; no pairs are made. With leaders, a
    row that is near one is decided and leaves; the work is rows times leaders. With members it is half of all pairs of
    rows, by matrix products, and the rounds are rows / block: for tables of a group's or a library's size.

    row_id is a long and unique. Null, zero and differently long vectors are near none of another length.
    """
    spark = rows.sparkSession
    done = storage.fresh_path(spark, "first-fit")
    fields = "row_id long, cluster long"
    slim = rows.select(F.col("row_id").cast("long"), F.col("vector").cast("array<double>"))
    alone = slim.where("vector is null").select("row_id", F.col("row_id").alias("cluster"))
    spark.createDataFrame([], fields).unionByName(alone).write.parquet(done)
    held = storage.stored(slim.where("vector is not null").withColumn("best", F.lit(NONE)), "first-fit-open")
    while first := held.orderBy("row_id").limit(block).collect():
        ids, labels = np.array([r.row_id for r in first]), np.array([r.best for r in first])
        kinds = {n: np.array([i for i, r in enumerate(first) if len(r.vector) == n]) for n in {len(r.vector) for r in first}}
        sent = []
        for n, at in kinds.items():
            x = _unit([first[i].vector for i in at]) if n else np.zeros((len(at), 1))
            near = (x @ x.T).round(6) >= threshold
            own = labels[at]
            for i in range(len(at)):
                before = np.flatnonzero(near[i, :i])
                if against == "leaders":
                    before = before[own[before] == ids[at[before]]]
                own[i] = min(own[i], own[before].min(initial=NONE))
                if own[i] == NONE:
                    own[i] = ids[at[i]]
            labels[at] = own
            lead = own == ids[at] if against == "leaders" else np.ones(len(at), bool)
            sent.append((n, x[lead], own[lead]))
        spark.createDataFrame(pd.DataFrame({"row_id": ids, "cluster": labels}), fields).coalesce(1).write.mode("append").parquet(done)
        shared = spark.sparkContext.broadcast(sent)

        def noted(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                best, size = frame.best.to_numpy().copy(), frame.vector.map(len).to_numpy()
                for n, x, own in shared.value:
                    at = np.flatnonzero(size == n)
                    if n and len(at) and len(x):
                        best[at] = np.minimum(best[at], _near_labels(_unit(frame.vector.iloc[at].tolist()), x, own, threshold))
                yield frame.assign(best=best)

        later = storage.stored(held.where(F.col("row_id") > int(ids[-1])).mapInPandas(noted, held.schema), "first-fit-open")
        storage.discard(held)
        held = later
        if against == "leaders":  # leaders come in order, so the first one that a row is near to is its own
            later.where(F.col("best") < NONE).select("row_id", F.col("best").alias("cluster")).write.mode("append").parquet(done)
            held = storage.stored(later.where(F.col("best") == NONE), "first-fit-open")
            storage.discard(later)
        shared.unpersist()
    storage.discard(held)
    return spark.read.schema(fields).parquet(done)


def cohesion(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """cluster, n, avg_sim (the mean cosine of all pairs of members, null for one): from sums of unit vectors, without pairs."""
    unit = rows.select(F.col("row_id").cast("long"), V.normalized(F.col("vector").cast("array<double>")).alias("u"))
    each = clusters.join(unit, "row_id", "left")
    sums = each.select("cluster", F.posexplode("u").alias("at", "c")).groupBy("cluster", "at").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    squares = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("pairs"))
    n = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.join(squares, "cluster", "left").select("cluster", "n", F.when(F.col("n") > 1, F.coalesce("pairs", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).alias("avg_sim"))


#: Rows on which centroids are fitted at most, and rows and queries that meet in one task at most (about).
FIT_ROWS, ROWS_EACH, QUERIES_EACH = 8192, 20_000, 2000


@dataclass(frozen=True)
class Index:
    """rows: row_id, vector, bucket; the unit centroids; and for each bucket with rows its number and widest angle."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: dict[int, tuple[int, float]]


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def indexed(rows: DataFrame, buckets: int = 64, rounds: int = 8) -> Index:
    """A bucketed index of all rows (row_id long, vector): each in the bucket of its nearest centroid by angle.

    Centroids are fitted by k-means on at most FIT_ROWS rows, chosen by a hash of row_id; the others don't matter for
    them, but all are in the index. Zero vectors are in a bucket of their own, -1. Null and empty vectors, and those that
    are not of the commonest length of these rows, are not in it.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col("row_id").cast("long"), F.col("vector").cast("array<double>")).where(F.size("vector") > 0)
    sample = slim.orderBy(F.xxhash64("row_id"), "row_id").limit(FIT_ROWS).toPandas()
    fields = "row_id long, vector array<double>, bucket int, angle double"
    if not len(sample):
        return Index(spark.createDataFrame([], fields), np.zeros((0, 0)), {})
    dim = int(sample.vector.map(len).mode()[0])
    x = _unit([v for v in sample.vector if len(v) == dim])
    centroids = x[:buckets]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        moved = _unit(sums.tolist())
        centroids = np.where(np.abs(moved).any(axis=1, keepdims=True), moved, centroids)
    sent = spark.sparkContext.broadcast(centroids)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame[frame.vector.map(len) == dim]
            if len(own):
                u = _unit(own.vector.tolist())
                angle, zero = _angles(u, sent.value), ~np.abs(u).any(axis=1)
                yield own.assign(bucket=np.where(zero, -1, angle.argmin(axis=1)).astype("int32"), angle=np.where(zero, np.pi, angle.min(axis=1)))

    table = storage.stored(slim.mapInPandas(dealt, fields), "vector-index")
    sizes = {r.bucket: (r.n, r.widest) for r in table.groupBy("bucket").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()}  # a row a bucket
    return Index(table, centroids, sizes)


def searched(queries: DataFrame, index: Index, k: int, probes: int, exact: bool = False) -> DataFrame:
    """query_id, row_id, score (cosine), rank of the k best rows for each query (query_id long, vector).

    A query is compared with the rows of its `probes` nearest buckets. One that finds fewer than k there is compared with
    all others too. exact: so is every other with the buckets that may hold a better row, as no row of a bucket is nearer
    to it than the angle to the centroid less the bucket's widest angle; the result is then that of retrieval.nearest.

    Buckets' rows and queries are dealt to cells of about ROWS_EACH rows and QUERIES_EACH queries, so a hot bucket is many
    tasks; what leaves a cell are k rows a query. Queries of another length than the centroids', and null ones, find nothing.
    """
    spark = queries.sparkSession
    schema = "query_id long, row_id long, score double"
    if not index.sizes:
        return retrieval.ranked(spark.createDataFrame([], schema), ["query_id"], [F.col("score").desc(), F.col("row_id")])
    asked = storage.stored(queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).where(F.size("vector") == index.centroids.shape[1]), "index-queries")
    buckets = np.array(sorted(index.sizes))
    widest = np.array([index.sizes[b][1] for b in buckets.tolist()])
    sent = spark.sparkContext.broadcast((index.centroids, buckets, widest))

    def reach(vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """For each query and bucket: the angle to its centroid, and the best cosine that it may hold."""
        centroids, names, wide = sent.value
        angle = np.where(names >= 0, _angles(_unit(vectors), centroids)[:, names], np.pi)  # the zero vectors' bucket comes last
        return angle, np.cos(np.clip(angle - wide, 0, np.pi))

    def nearest_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                first = np.argsort(reach(frame.vector.tolist())[0], axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(frame)), first.shape[1])
                yield frame.iloc[rows].assign(bucket=sent.value[1][first.ravel()])

    def other_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                angle, best = reach(frame.vector.tolist())
                seen = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1) < probes
                least = np.where(frame.found.to_numpy() < k, -np.inf, frame.least.fillna(0).to_numpy() if exact else np.inf)
                at, b = np.nonzero(~seen & (best + 1e-6 >= least[:, None]))
                yield frame.iloc[at][["query_id", "vector"]].assign(bucket=sent.value[1][b])

    pairs = "query_id long, vector array<double>, bucket int"
    found = storage.stored(_compared(asked.mapInPandas(nearest_buckets, pairs), index, k), "index-found")
    so_far = found.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    open_ = asked.join(so_far, "query_id", "left").select("query_id", "vector", F.coalesce("found", F.lit(0)).alias("found"), "least")
    every = found.unionByName(_compared(open_.mapInPandas(other_buckets, pairs), index, k))
    return retrieval.ranked(every, ["query_id"], [F.col("score").desc(), F.col("row_id")]).where(F.col("rank") <= k)


def _compared(pairs: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, row_id, score: the k best rows of all buckets that a query is paired with (query_id, vector, bucket)."""
    spark = pairs.sparkSession
    held = storage.stored(pairs, "index-probes")
    asked = {r.bucket: r["count"] for r in held.groupBy("bucket").count().collect()}  # a row a bucket
    ways = spark.createDataFrame([(b, -(-index.sizes[b][0] // ROWS_EACH), -(-n // QUERIES_EACH)) for b, n in asked.items()], "bucket int, __r int, __q int")
    cell = lambda ways, key: F.pmod(F.xxhash64(key), F.col(ways)).cast("int")
    each = lambda ways: F.explode(F.sequence(F.lit(0), F.col(ways) - 1))
    rows = index.rows.join(F.broadcast(ways), "bucket").select("bucket", "row_id", "vector", cell("__r", "row_id").alias("r"), each("__q").alias("q"))
    wanted = held.join(F.broadcast(ways), "bucket").select("bucket", "query_id", "vector", each("__r").alias("r"), cell("__q", "query_id").alias("q"))

    def cell_best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "row_id": [], "score": []})
        rows = rows.sort_values("row_id")
        at = (_unit(queries.vector.tolist()) @ _unit(rows.vector.tolist()).T).round(6)
        first = np.argsort(-at, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(queries.query_id.to_numpy(), first.shape[1]), "row_id": rows.row_id.to_numpy()[first.ravel()], "score": np.take_along_axis(at, first, 1).ravel()})

    cells = wanted.groupBy("bucket", "r", "q").cogroup(rows.groupBy("bucket", "r", "q")).applyInPandas(cell_best, "query_id long, row_id long, score double")
    return retrieval.ranked(cells, ["query_id"], [F.col("score").desc(), F.col("row_id")]).where(F.col("rank") <= k).drop("rank")


@F.pandas_udf(BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of an array."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decoded(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """rows with `vector` (array<float>), `norm` and `problem` of a packed column: null, ragged (no whole number of floats),
    dimension (not `dim` of them), not finite, zero, or null where nothing is wrong. A bad row has neither vector nor norm:
    rows with a problem are the quarantine.
    """

    @F.pandas_udf("vector array<float>, norm double, problem string")
    def run(blobs: pd.Series) -> pd.DataFrame:
        size = blobs.map(lambda b: -1 if b is None else len(b)).to_numpy()
        problem = np.select([size < 0, size % 4 != 0, size != 4 * dim], ["null", "ragged", "dimension"], "").astype(object)
        good = np.flatnonzero(problem == "")
        x = np.frombuffer(b"".join(blobs.iloc[good]), "<f4").reshape(-1, dim)
        norm = np.linalg.norm(x.astype(float), axis=1)
        problem[good] = np.select([~np.isfinite(norm), norm == 0], ["not finite", "zero"], "")
        vectors, norms = np.full(len(blobs), None, dtype=object), np.full(len(blobs), None, dtype=object)
        for i, v, n in zip(good, x, norm, strict=True):
            if problem[i] == "":
                vectors[i], norms[i] = v, n
        return pd.DataFrame({"vector": vectors, "norm": norms, "problem": np.where(problem == "", None, problem)})

    return rows.withColumn("__d", run(F.col(column))).select(*rows.columns, "__d.vector", "__d.norm", "__d.problem")


def rebuilt_index(rows: DataFrame, dim: int, buckets: int = 64) -> tuple[Index, DataFrame]:
    """An index of packed rows (row_id, blob) without those in quarantine, and these with their problem."""
    read = storage.stored(decoded(rows, "blob", dim), "decoded-vectors")
    return indexed(read.where("problem is null"), buckets), read.where("problem is not null").select("row_id", "problem")


def quarantine_counts(read: DataFrame, problem: Column | str = "problem") -> DataFrame:
    """problem (ok for none), n."""
    return read.groupBy(F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))
