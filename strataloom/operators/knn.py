"""Exact k nearest neighbours over blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of one train block and of one query chunk; a task holds one distance matrix of them.
TRAIN_BLOCK = 2_000
QUERY_CHUNK = 5_000


def _closest(a: np.ndarray, b: np.ndarray, k: int):
    """Rows of ``a``, rows of ``b`` and squared distances of the ``k`` nearest, a bounded part at a time; ties go to the first row of ``b``."""
    if not len(b):
        return
    step = max(1, 2_000_000 // len(b))
    for s in range(0, len(a), step):
        d = np.zeros((len(a[s:s + step]), len(b)))
        for f in range(a.shape[1]):
            d += (a[s:s + step, f, None] - b[None, :, f]) ** 2
        near = np.partition(d, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        rows, cols = np.nonzero(d <= near[:, None])
        order = np.lexsort((cols, d[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols = rows[rank < k], cols[rank < k]
        yield rows + s, cols, d[rows, cols]


def batch_votes(queries: np.ndarray, x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """0/1 votes of the ``k`` rows of one batch that are nearest to each query; ties go to the first rows of the batch."""
    out = np.zeros(len(queries))
    np.nan_to_num(queries, copy=False)  # such rows get no share in the end
    for rows, cols, _ in _closest(queries, x, k):
        hits = np.bincount(rows, weights=labels[cols], minlength=len(queries))
        sizes = np.bincount(rows, minlength=len(queries))
        out += (sizes > 0) & (2 * hits > sizes)
    return out


def nearest(queries: DataFrame, train: DataFrame, by, features, target: str, query_id: str, train_id: str,
            k: int, n_queries: int, n_train: int) -> DataFrame:
    """The ``k`` nearest train rows of each query: ``(by, query_id, distance2, train_id, label)``.

    Both sides are cut into hashed blocks; every query chunk meets every train block once,
    each meeting keeps only its ``k`` best, and the best of all blocks are kept at the end.
    Ties go to the smaller ``train_id``.
    """
    by, features = list(by), list(features)
    blocks = max(1, -(-n_train // TRAIN_BLOCK))
    chunks = max(1, -(-n_queries // QUERY_CHUNK))

    def part(df: DataFrame, own: str, own_parts: int, other: str, other_parts: int, key: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_parts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)))
        )

    left = part(
        queries.select(*[F.col(c).alias(c) for c in by], F.col(query_id).alias("__q"), *[F.col(c).cast("double").alias(c) for c in features]),
        "__chunk", chunks, "__block", blocks, "__q",
    )
    right = part(
        train.select(*[F.col(c).alias(c) for c in by], F.col(train_id).alias("__t"), F.col(target).cast("int").alias("__label"),
                     *[F.col(c).cast("double").alias(c) for c in features]),
        "__block", blocks, "__chunk", chunks, "__t",
    )

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("__t", ignore_index=True)
        a, b = q[features].to_numpy(dtype=float), t[features].to_numpy(dtype=float)
        found = list(_closest(a, b, k))
        rows = np.concatenate([f[0] for f in found]) if found else np.array([], dtype=int)
        cols = np.concatenate([f[1] for f in found]) if found else np.array([], dtype=int)
        out = q[[*by, "__q"]].iloc[rows].reset_index(drop=True)
        out["__d"] = np.concatenate([f[2] for f in found]) if found else np.array([], dtype=float)
        out["__t"] = t["__t"].to_numpy()[cols]
        out["__label"] = t["__label"].to_numpy()[cols]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*by, "__q"]], "__d double", f"__t {kinds['__t']}",
                        "__label int"])
    meet = [*by, "__chunk", "__block"]
    candidates = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(best, schema)
    if blocks > 1:
        closest = Window.partitionBy(*by, "__q").orderBy("__d", "__t")
        candidates = candidates.withColumn("__rank", F.row_number().over(closest)).filter(F.col("__rank") <= k)
    return candidates.select(
        *by, F.col("__q").alias(query_id), F.col("__d").alias("distance2"), F.col("__t").alias(train_id),
        F.col("__label").alias("label"),
    )


def knn_votes(neighbours: DataFrame, by, query_id: str) -> DataFrame:
    """Majority label of the neighbours; a tie counts as 0."""
    return neighbours.groupBy(*by, query_id).agg((F.avg("label") > 0.5).cast("int").alias("vote"))
