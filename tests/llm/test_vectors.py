"""Whitening and nearest neighbours against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.neighbours import CentroidGraph, balanced_centroids, nearest
from corvane.llm.whitening import eigenvectors, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, x string, component int"
ODD = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]


def table(spark, vectors, ids=None, odd=True):
    rows = [(i, v, "extra", "extra", 3) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows + ([(10_000 + i, v, "e", "e", 1) for i, v in enumerate(ODD)] if odd else []), SCHEMA).repartition(3)


def steps(vectors):
    return np.floor(1024 * np.float32(vectors).astype(float)).astype(np.int64) + 100_000


@pytest.mark.parametrize("size", [1, 2, 3, 17, 60])
@pytest.mark.parametrize("kind", ["random", "equal", "pairs", "one", "zero", "ones"])
def test_eigenvectors_are_those_of_lapack(size, kind):
    rng = np.random.default_rng(size)
    made = rng.standard_normal((size, 2 * size))
    a = {"random": made @ made.T, "equal": 3 * np.eye(size), "pairs": np.diag(np.arange(size) // 2).astype(float), "one": np.outer(made[:, 0], made[:, 0]),
         "zero": np.zeros((size, size)), "ones": np.ones((size, size)) - np.eye(size)}[kind]
    v = eigenvectors(a, 8)
    e = np.einsum("ki,ij,kj->k", v, a, v)
    scale = max(1.0, np.abs(a).max())
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:8], atol=1e-11 * scale)
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-13) and np.allclose(a @ v.T, v.T * e, atol=1e-11 * scale)


def test_whitening_equals_numpy(spark):
    vectors = (np.random.default_rng(3).standard_normal((300, 3)) @ np.array([[3, 1, 0], [0, 1, 0.2], [0, 0, 0.1]]) + 50).astype(np.float32)
    got = whiten(table(spark, vectors.tolist()), components=8).toPandas()
    assert set(got.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"} and len(got) == 900
    x, n = steps(vectors), len(vectors)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - x.mean(axis=0)) @ axes / np.sqrt(values)
    assert (got["n"] == n).all() and (got["identity_error"] < 1e-10).all() and got["identity_error"].nunique() == 1
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    for c in range(3):
        part = got[got["component"] == c + 1].sort_values("vec_id")
        w = part["whitened"].to_numpy()
        assert np.allclose(w * np.sign(w[0] * want[0, c]), want[:, c], atol=1e-9)
        assert np.allclose(part["explained"], values[c] / values.sum(), rtol=1e-10)
        assert part["deviation"].astype(object).map(int).tolist() == deviation.tolist()


def test_whitening_of_alike_repeated_few_and_no_vectors(spark):
    alike = whiten(table(spark, [[1.0, 2.0, 3.0]] * 5, ids=[1, 1, None, 2, 2]), components=2).collect()
    assert len(alike) == 10 and all(r["whitened"] is None and r["identity_error"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in alike)
    flat = whiten(table(spark, [[0.0, 1.0, 5.0], [1.0, 1.0, 5.0], [3.0, 1.0, 5.0]]), components=2).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and all(r["identity_error"] < 1e-12 for r in flat)
    none = whiten(table(spark, [], odd=False))
    assert none.count() == 0 and none.columns[0] == "vec_id"


def test_deviation_is_exact_beyond_a_long(spark):
    vectors = [[1e9, 0.0, 0.0], [-1e9, 0.0, 0.0], [0.0, 7.0, 0.0]]
    got = {r["vec_id"]: int(r["deviation"]) for r in whiten(table(spark, vectors, odd=False), components=1).collect()}
    x = [[int(v) for v in row] for row in steps(vectors)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}


def brute(vectors, ids, query, k):
    x = np.float32(vectors).astype(float)
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    other = [(d[i], math.inf if ids[i] is None else ids[i], ids[i]) for i in range(len(ids)) if ids[i] != ids[query]]
    return [(i, s) for s, _, i in sorted(other, key=lambda r: r[:2])[:k]]


def test_neighbours_reach_the_recall_with_copies_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr("corvane.llm.neighbours.PART_ROWS", 50)
    monkeypatch.setattr("corvane.llm.neighbours.BLOCK_ROWS", 5)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((1500, 12)).astype(np.float32)
    vectors[300:800] = vectors[300]  # a third are copies
    got = nearest(table(spark, vectors.tolist()), F.col("vec_id") % 50 == 0, k=10).toPandas()
    hits = 0
    for q in range(0, 1500, 50):
        part = got[got["query_id"] == q].sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11)) and part["vec_id"].is_unique and q not in set(part["vec_id"])
        want = brute(vectors, list(range(1500)), q, 10)
        hits += len(set(part["vec_id"]) & {i for i, _ in want})
        order = list(zip(part["score"], part["vec_id"], strict=True))
        assert order == sorted(order)
        x = np.float64(vectors)
        assert np.allclose(part["score"], np.sqrt(((x[part["vec_id"]] - x[q]) ** 2).sum(axis=1)), atol=1e-12)
    assert hits >= 0.9 * 300
    assert got[got["query_id"] == 300]["vec_id"].tolist() == list(range(301, 311)) and (got[got["query_id"] == 300]["score"] == 0).all()


def test_neighbours_of_few_tied_null_and_no_rows(spark):
    few = nearest(table(spark, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]], ids=[0, 1, 2, None, 3]), F.col("vec_id") == 0, k=10)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(1, 1), (2, 3), (3, None)]  # the zero vector takes no part
    again = nearest(table(spark, [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [3.0, 0.0, 0.0], [3.0, 0.0, 0.0]], ids=[0, 0, 1, 1]), F.col("vec_id") == 0, k=3)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in again.collect()) == [(1, 1, 1.0), (1, 1, 2.0), (2, 1, 1.0), (2, 1, 2.0)]
    assert nearest(table(spark, [], odd=False), F.lit(True)).count() == 0
    assert nearest(table(spark, [[1.0, 0.0, 0.0]]), F.lit(False)).count() == 0


def test_all_candidates_come_where_there_are_fewer(spark):
    vectors = np.random.default_rng(6).standard_normal((8, 3)).tolist()
    got = nearest(table(spark, vectors), F.col("vec_id") < 8, k=10).groupBy("query_id").count().collect()
    assert [r["count"] for r in got] == [7] * 8


def test_lists_are_balanced_and_the_graph_finds_centroids():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((4000, 8)) * 0.05, rng.standard_normal((1000, 8)) + 3])
    c = balanced_centroids(x, 50)
    near = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert np.bincount(near.argmin(axis=1), minlength=len(c)).max() < 6 * len(x) / len(c)
    graph = CentroidGraph(c)
    found, dist = graph.nearest(x[:500])
    assert (found[:, 0] == near[:500].argmin(axis=1)).mean() > 0.99 and (np.diff(dist, axis=1) >= 0).all()
    assert all(len(set(row)) == len(row) for row in found.tolist())
    lists = graph.within(x[0], 1.5, np.ones(len(c), int), 3)
    d = np.sqrt(near[0])
    assert len(lists) >= 3 and set(np.flatnonzero(d <= 1.5 * d.min()).tolist()) <= set(lists.tolist())
    assert len(balanced_centroids(np.ones((100, 4)), 10)) == 1  # copies are one centroid
