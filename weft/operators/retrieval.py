"""Exact vector search, fusion of rankings, re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

#: Numbers of query vectors that a task holds at once.
BLOCK_NUMBERS = 32 << 20


def _dimensions(queries: DataFrame) -> tuple[int, int]:
    """Queries, and numbers in all of their vectors."""
    return tuple(x or 0 for x in queries.agg(F.count("*"), F.sum(F.size("vector"))).first())


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", tenant: str | None = None) -> DataFrame:
    """query_id, row_id, score, rank of the k best rows for each query, exactly; ties go to the smaller row_id.

    queries: query_id, vector; rows: row_id, vector; both with the tenant column if one is named: a query sees its
    tenant's rows only. Scores: cosine, or 1 / (1 + L2 distance). Rows are scanned in batches by matrix products
    against all queries, each task keeps k of its rows for a query, and those few are ranked. Queries are collected and
    broadcast in blocks by a hash of their id, as many as their counted numbers need: rows are scanned once a block.
    """
    asked = queries.select("query_id", "vector", *([tenant] if tenant else [])).where("vector is not null")
    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["row_id"]
    fields = f"query_id {kinds[0]}, row_id {kinds[1]}, score double"
    parts = _blocks(asked)
    found = reduce(DataFrame.unionByName, (_scanned(part, rows, k, metric, tenant, fields) for part in parts)) if parts else rows.sparkSession.createDataFrame([], fields)
    return ranked(found, ["query_id"], [F.col("score").desc(), F.col("row_id")]).where(F.col("rank") <= k)


def _blocks(asked: DataFrame) -> list[DataFrame]:
    """The queries in blocks by a hash of their id, so many that each block's numbers can be sent to every task."""
    n, numbers = _dimensions(asked)
    blocks = -(-numbers // BLOCK_NUMBERS)
    return [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked for i in range(blocks)] if n else []


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query: cosine (0 for a zero vector), or 1 / (1 + L2 distance)."""
    if metric == "cosine":
        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(q @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0).round(6)
    return np.array([1 / (1 + np.sqrt(((x - v) ** 2).sum(1))) for v in q]).round(6)


def scored(queries: DataFrame, rows: DataFrame, keep: list[str], metric: str = "cosine") -> DataFrame:
    """query_id, the columns `keep` of rows, score: every row against each of a few stated queries, in one scan a block.

    Vectors of a dimension that a query doesn't have, and null ones, have no score for it. All scores come out: aggregate
    them, or take nearest().
    """
    asked = queries.select("query_id", "vector").where("vector is not null")
    kinds = dict(rows.dtypes)
    fields = ", ".join(["query_id " + dict(queries.dtypes)["query_id"], *(f"{c} {kinds[c]}" for c in keep), "score double"])

    def scan(block: DataFrame) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(_by_dimension(block.toPandas()))

        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                size = frame.vector.map(lambda v: -1 if v is None else len(v))
                for ids, q, _ in sent.value:
                    own = frame[size == q.shape[1]]
                    if len(own):
                        at = _scores(q, np.array(own.vector.tolist(), float), metric)
                        every = pd.concat([own[keep]] * len(ids), ignore_index=True)
                        every.insert(0, "query_id", np.repeat(ids, len(own)))
                        yield every.assign(score=at.ravel())

        return rows.select(*keep, "vector").mapInPandas(step, fields)

    parts = [scan(b) for b in _blocks(asked)]
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], fields)


def _by_dimension(held: pd.DataFrame, tenant: str | None = None) -> list[tuple]:
    return [(own.query_id.to_numpy(), np.array(own.vector.tolist(), float), own[tenant].to_numpy() if tenant else None) for _, own in held.groupby(held.vector.map(len))]


def _scanned(queries: DataFrame, rows: DataFrame, k: int, metric: str, tenant: str | None, fields: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(_by_dimension(queries.toPandas(), tenant))  # a block

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by the queries' dimension: ids, row ids, scores
        for frame in frames:
            size = frame.vector.map(lambda v: -1 if v is None else len(v))
            for ids, q, owner in sent.value:
                own = frame[size == q.shape[1]]
                if not len(own):
                    continue
                at = _scores(q, np.array(own.vector.tolist(), float), metric)
                if owner is not None:
                    at[owner[:, None] != own[tenant].to_numpy()[None, :]] = -np.inf
                rid = np.broadcast_to(own.row_id.to_numpy(), at.shape)
                if q.shape[1] in best:
                    _, before, old = best[q.shape[1]]
                    rid, at = np.concatenate([before, rid], axis=1), np.concatenate([old, at], axis=1)
                first = np.lexsort((rid, -at), axis=1)[:, :k]
                best[q.shape[1]] = ids, np.take_along_axis(rid, first, 1), np.take_along_axis(at, first, 1)
        for ids, rid, at in best.values():
            ok = np.isfinite(at)
            yield pd.DataFrame({"query_id": np.repeat(ids, ok.sum(1)), "row_id": rid[ok], "score": at[ok]})

    return rows.select("row_id", "vector", *([tenant] if tenant else [])).mapInPandas(step, fields)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fused(rankings: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: keys, score = sum of 1 / (k + rank) over the rankings (keys, rank) that have them."""
    both = rankings[0].select(*keys, "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select(*keys, "rank"))
    return both.groupBy(*keys).agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def near_top(rows: DataFrame, keys: list[str], score: str, gap: float) -> DataFrame:
    """Rows whose score is at most `gap` below the best of their keys."""
    return rows.withColumn("__top", F.max(score).over(Window.partitionBy(*keys))).where(F.col(score) >= F.col("__top") - gap).drop("__top")


def above_share(rows: DataFrame, keys: list[str], score: str, share: float) -> DataFrame:
    """Rows whose score is at least `share` of the best of their keys."""
    return rows.withColumn("__top", F.max(score).over(Window.partitionBy(*keys))).where(F.col(score) >= F.col("__top") * share).drop("__top")


def tiers(rows: DataFrame, keys: list[str], position: str, exact: Column, alike: Column) -> DataFrame:
    """Adds tier (0 exact, 1 alike, 2 other) and new_rank: tiers first, the old position within each."""
    tier = F.when(exact, 0).when(alike, 1).otherwise(2)
    return ranked(rows.withColumn("tier", tier), keys, [F.col("tier"), F.col(position)], "new_rank")


def keyword_score(name: Column, parts: Column, query: str) -> Column:
    """5 for the name and 1 for each part that contains the query, in any case."""
    q = F.lit(query.lower())
    return F.when(F.contains(F.lower(name), q), 5).otherwise(0) + F.size(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.contains(F.lower(p), q)))


def taken(pairs: Column, fields: DataType) -> Column:
    """Of an array of pairs (score, slot, candidate; `fields` is their struct), those that are taken when the best goes first
    (ties by slot and candidate, NaN and nulls last), each slot and each candidate once. Pairs without a score are left out.

    Rows are sorted in the JVM and come to Python by the batch; a row's work there is one look at each of its pairs.
    """
    ordered = lambda p: F.struct((-p["score"]).alias("__n"), p["slot"].isNull(), p["slot"], p["candidate"].isNull(), p["candidate"], p.alias("p"))
    best = F.transform(F.sort_array(F.transform(F.filter(pairs, lambda p: p["score"].isNotNull()), ordered)), lambda x: x["p"])

    @F.arrow_udf(ArrayType(fields))
    def fold(rows: pa.Array) -> pa.Array:
        every, ends = rows.flatten(), np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False)).tolist()
        # numbers for values, of any type: a null has -1
        slot, candidate = (every.field(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist() for c in ("slot", "candidate"))
        kept, offsets, begin = [], [0], 0
        for end in ends:
            slots, candidates = set(), set()
            for i in range(begin, end):
                if (s := slot[i]) not in slots and (c := candidate[i]) not in candidates:
                    slots.add(s)
                    candidates.add(c)
                    kept.append(i)
            offsets.append(len(kept))
            begin = end
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), every.take(pa.array(kept, pa.int64())))

    return fold(best)


def assigned(scores: DataFrame, key: str, slot: str, candidate: str, score: str) -> DataFrame:
    """key, slot, candidate, score: within a key, the best pair first (ties by slot and candidate), each slot and each
    candidate once. A key's pairs are gathered in one row."""
    pair = F.struct(F.col(score).alias("score"), F.col(slot).alias("slot"), F.col(candidate).alias("candidate"))
    rows = scores.where(F.col(score).isNotNull()).groupBy(key).agg(F.collect_list(pair).alias("__pairs"))
    return picked(rows, key, slot, candidate, score)


def picked(rows: DataFrame, key: str, slot: str, candidate: str, score: str) -> DataFrame:
    """assigned() for rows that have the pairs of a key (score, slot, candidate) in the array __pairs."""
    found = rows.select(key, F.explode(taken(F.col("__pairs"), rows.schema["__pairs"].dataType.elementType)).alias("p"))
    return found.select(key, F.col("p.slot").alias(slot), F.col("p.candidate").alias(candidate), F.col("p.score").alias(score))


def guarded_tiers(rows: DataFrame, keys: list[str], position: str, kind: str, wanted: Column, exact: Column) -> DataFrame:
    """tiers() for keys whose first row by position is of the wanted kind; the others keep their order, in tier 2."""
    first = rows.groupBy(*keys).agg(F.min_by(kind, position).alias("__kind"))
    both = rows.join(first, keys).withColumn("__same", F.coalesce(F.col("__kind") == wanted, F.lit(False)))
    found = tiers(both, keys, position, F.col("__same") & exact, F.col("__same") & (F.col(kind) == wanted))
    return found.drop("__kind", "__same")


def near_ties(rows: DataFrame, keys: list[str], score: str, gap: float, breakers: list[Column]) -> DataFrame:
    """Adds rank: rows whose score is at most `gap` below the best of their keys by the breakers (the
    smallest first), then the rest by score and these."""
    top = rows.groupBy(*keys).agg(F.max(score).alias("__top"))
    both = rows.join(top, keys).withColumn("__tied", F.col(score) >= F.col("__top") - gap)
    tied = [F.when(F.col("__tied"), b) for b in breakers]
    return ranked(both, keys, [F.col("__tied").desc(), *tied, F.col(score).desc(), *breakers]).drop("__top", "__tied")
