"""Recall of the nearest neighbours over several shards, on vectors that are hard for a graph."""

import numpy as np
import pytest

from strataloom.llm import ann


def _found(spark, v, every, k=20, **kw):
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    out = {}
    for r in ann.nearest(rows, rows.where(f"vec_id % {every} = 0"), k=k, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def _recall(found, v, k=20):
    hits = total = 0
    for q, near in found.items():
        same = [i for i in range(len(v)) if len(v[i]) == len(v[q]) and i != q]
        scores = np.array([v[i] @ v[q] for i in same])
        least = np.sort(scores)[-min(k, len(same))]
        hits, total = hits + sum(s >= least - 1e-9 * abs(least) for _, s in near), total + min(k, len(same))
        for i, s in near:
            assert np.isclose(s, v[i] @ v[q], rtol=1e-12)
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
    return hits / total


def _gaussian(n, dim, unit=False, long=0.0):
    v = np.random.default_rng(7).normal(size=(n, dim))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if unit else v
    if long:
        v[n // 2] *= long
    return v


@pytest.mark.parametrize("vectors", [
    _gaussian(5000, 64), _gaussian(4000, 64, long=10.0), _gaussian(4000, 64, long=1e4), _gaussian(4000, 32, long=1e25), _gaussian(3000, 256, unit=True),
    _gaussian(3000, 16) * np.exp(np.random.default_rng(1).normal(size=(3000, 1))),
])
def test_recall_over_shards(spark, vectors):
    assert _recall(_found(spark, vectors, 50, shard_rows=1500), vectors) >= 0.95


def test_vectors_of_several_dimensions(spark):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=int(rng.integers(1, 5))) for _ in range(300)] + [np.array([1.0, 0.0]), np.array([1.0, 2.0, 3.0, 4.0]), np.array([3.0, 4.0]), np.array([0.5, 0.5]), np.ones(9)]
    found = _found(spark, v, 1)
    assert _recall(found, v) == 1.0 and 304 not in found  # nothing else has nine components
    assert all(len(near) == min(20, sum(len(x) == len(v[q]) for x in v) - 1) for q, near in found.items())


def test_repeated_rows_count_once(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])] * 40 + [(1, [2.0, 1.0]), (2, [1.0, 1.0]), (0, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, rows.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 6.0), (1, 3.0), (2, 3.0)]


def test_large_and_small_numbers(spark):
    v = np.random.default_rng(5).normal(size=(300, 4)) * 10.0 ** np.random.default_rng(6).integers(-140, 140, size=(300, 1))
    assert _recall(_found(spark, v, 10), v) >= 0.95
