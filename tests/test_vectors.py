"""First-fit clusters against the sequential fold, the index against exact search, packed vectors back and forth."""

import math

import numpy as np
import pytest

from tests.conftest import DATA
from weft.catalog import retrieval as catalog
from weft.operators import retrieval, vectors


def some(n=120, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).round(3).tolist()) for i in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, [0.0] * dim), (n + 3, [0.0] * dim), (n + 4, None), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    return rows


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def folded(rows, threshold, leaders):
    groups = []
    for i, v in rows:
        for g in groups:
            if max(cosine(v, m) for _, m in (g[:1] if leaders else g)) >= threshold:
                g.append((i, v))
                break
        else:
            groups.append([(i, v)])
    return groups


@pytest.mark.parametrize("against", ["members", "leaders"])
@pytest.mark.parametrize("block", [30, 2048])
def test_first_fit_is_the_sequential_fold(spark, against, block):
    rows = some()
    table = spark.createDataFrame(rows, "row_id long, vector array<double>").repartition(3)
    groups = folded(rows, 0.8, against == "leaders")
    assert {(r.row_id, r.cluster) for r in vectors.first_fit(table, 0.8, against, block).collect()} == {(i, g[0][0]) for g in groups for i, _ in g}
    assert any(len(g) > 3 for g in groups) and sum(len(g) == 1 for g in groups) > 3


def test_cohesion_is_the_mean_of_all_pairs(spark):
    rows = some(60)
    table = spark.createDataFrame(rows, "row_id long, vector array<double>")
    found = {r.cluster: r for r in vectors.cohesion(vectors.first_fit(table, 0.6), table).collect()}
    for g in folded(rows, 0.6, False):
        pairs = [np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) for i, (_, a) in enumerate(g) for _, b in g[:i]]
        r = found[g[0][0]]
        assert r.n == len(g) and (r.avg_sim is None if len(g) == 1 else r.avg_sim == pytest.approx(sum(pairs) / len(pairs)))
    assert len(found) == len(folded(rows, 0.6, False))


def test_first_fit_of_nothing(spark):
    assert vectors.first_fit(spark.createDataFrame([], "row_id long, vector array<double>")).count() == 0


def both(spark, rows, queries, k, probes, buckets, exact=True):
    table = spark.createDataFrame(rows, "row_id long, vector array<double>").repartition(4)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    key = ["query_id", "rank", "row_id", "score"]
    found = vectors.searched(asked, vectors.indexed(table, buckets), k, probes, exact).select(key)
    return sorted(map(tuple, found.collect())), sorted(map(tuple, retrieval.nearest(asked, table, k).select(key).collect()))


@pytest.mark.parametrize(("buckets", "probes", "cells"), [(1, 1, False), (8, 1, True), (40, 2, False)])
def test_exact_index_is_exact_search(spark, monkeypatch, buckets, probes, cells):
    if cells:  # hot buckets become many cells
        monkeypatch.setattr(vectors, "ROWS_EACH", 9)
        monkeypatch.setattr(vectors, "QUERIES_EACH", 2)
    rows = [r for r in some(200) if r[1] is not None and len(r[1]) == 5] + [(1000 + i, some()[3][1]) for i in range(60)]
    queries = [(i, v) for i, v in rows if i % 17 == 0] + [(5000, [0.0] * 5), (5001, None)]
    got, want = both(spark, rows, queries, 4, probes, buckets)
    assert got == want and len(got) == 4 * (len(queries) - 1)


def test_a_short_bucket_falls_back_to_all_rows(spark):
    rows = [(i, v) for i, v in some(30) if v is not None and len(v) == 5]
    got, want = both(spark, rows, [(1, rows[1][1])], 25, 1, 20, exact=False)
    assert got == want


def test_index_of_nothing(spark):
    table = spark.createDataFrame([], "row_id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert vectors.searched(asked, vectors.indexed(table), 3, 2).count() == 0


def test_recall_of_the_registered_index(spark):
    found = {(r.query_id, r.row_id) for r in catalog.indexed_knn(spark, DATA).collect()}
    want = {(r.query_id, r.row_id) for r in catalog.indexed_knn_exact(spark, DATA).collect()}
    assert len(found & want) >= 0.9 * len(want) and len(found) == len(want)


def test_packed_vectors_round_trip_and_quarantine(spark):
    inf = float("inf")
    rows = [(1, [1.5, -2.0, 0.1]), (2, None), (3, [1.0, 2.0]), (4, [0.0, 0.0, 0.0]), (5, [inf, 0.0, 1.0]), (6, [float("nan")] * 3), (7, [])]
    table = spark.createDataFrame(rows, "id long, v array<float>").select("id", vectors.packed("v").alias("blob"))
    ragged = spark.createDataFrame([(8, bytearray(b"12345"))], "id long, blob binary")
    found = {r.id: r for r in vectors.decoded(table.union(ragged), "blob", 3).collect()}
    assert [found[i].problem for i in range(1, 9)] == [None, "null", "dimension", "zero", "not finite", "not finite", "dimension", "ragged"]
    assert found[1].vector == [1.5, -2.0, float(np.float32(0.1))] and found[1].norm == pytest.approx(math.sqrt(6.26))
    assert all(found[i].vector is None and found[i].norm is None for i in range(2, 9))


def test_rebuilt_index_leaves_the_quarantine_out(spark):
    rows = [(i, v) for i, v in some(40) if v is not None]
    table = spark.createDataFrame(rows, "row_id long, vector array<double>").select("row_id", vectors.packed("vector").alias("blob"))
    index, bad = vectors.rebuilt_index(table, 5, 4)
    assert index.rows.count() + bad.count() == len(rows) and {r.problem for r in bad.collect()} == {"zero", "dimension"}
