"""Signal compression: cluster the frame columns, then one value per cluster and row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.estimators import estimator
from strataloom.materialize import settle
from strataloom.operators.cells import CELL, WEIGHT, FitCells
from strataloom.operators.gram import grouped_gram, matrix_of
from strataloom.operators.keyed import Keyed
from strataloom.operators.subjects import require_columns

_MAX_ROUNDS = 300
# Above this many cells their Gram matrices cost more than a pass over the rows of every fold.
MAX_GRAM_CELLS = 1_000


def cluster_columns(gram: np.ndarray, k: int) -> np.ndarray:
    """k-means labels of the columns behind a Gram matrix, farthest-point start.

    Needs only the p×p matrix: the squared distance of column i to the mean of cluster C is
    ``G_ii - 2 mean_j G_ij + mean_jl G_jl`` with j, l in C. Labels follow first columns.
    """
    p = len(gram)
    diag = np.diag(gram)
    seeds = [0]
    nearest = diag + diag[0] - 2 * gram[:, 0]
    while len(seeds) < k:
        nearest[seeds] = -np.inf
        seeds.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, diag + diag[seeds[-1]] - 2 * gram[:, seeds[-1]])
    far = np.stack([diag + diag[s] - 2 * gram[:, s] for s in seeds], axis=1)
    far[seeds, range(k)] = -np.inf
    labels = far.argmin(axis=1)
    for _ in range(_MAX_ROUNDS):
        member = np.eye(k)[labels]
        size = member.sum(axis=0)
        mean = gram @ member / size
        far = diag[:, None] - 2 * mean + np.einsum("ic,ic->c", member, mean) / size
        moved = far.argmin(axis=1)
        # a cluster left empty takes the column farthest from its own centre
        for c in range(k):
            if not (moved == c).any():
                spare = far[np.arange(p), moved] - np.where(np.bincount(moved, minlength=k)[moved] > 1, 0, np.inf)
                moved[int(np.argmax(spare))] = c
        if (moved == labels).all():
            break
        labels = moved
    return by_first_column(labels)


def segment_columns(gram: np.ndarray, k: int) -> np.ndarray:
    """Best split of the columns into k contiguous runs, by least within-run variance."""
    p = len(gram)
    area = np.zeros((p + 1, p + 1))
    area[1:, 1:] = gram.cumsum(0).cumsum(1)
    diag = np.concatenate([[0.0], np.diag(gram).cumsum()])

    def cost(a: int, b: int) -> float:
        inside = area[b, b] - area[a, b] - area[b, a] + area[a, a]
        return diag[b] - diag[a] - inside / (b - a)

    best = np.full((k + 1, p + 1), np.inf)
    cut = np.zeros((k + 1, p + 1), dtype=int)
    best[0, 0] = 0.0
    for runs in range(1, k + 1):
        for end in range(runs, p + 1):
            options = [best[runs - 1, a] + cost(a, end) for a in range(runs - 1, end)]
            cut[runs, end] = runs - 1 + int(np.argmin(options))
            best[runs, end] = min(options)
    labels, end = np.zeros(p, dtype=int), p
    for runs in range(k, 0, -1):
        labels[cut[runs, end]:end] = runs - 1
        end = cut[runs, end]
    return labels


def by_first_column(labels: np.ndarray) -> np.ndarray:
    order = {label: n for n, label in enumerate(dict.fromkeys(labels.tolist()))}
    return np.array([order[label] for label in labels.tolist()])


def fit_groups(df: DataFrame, keys, columns, k: int, weight: str | None = None, contiguous: bool = False,
               cells: FitCells | None = None) -> DataFrame:
    """Column positions of each cluster, ``(keys, groups array<array<int>>)``, one row per key."""
    p = len(columns)
    if not 1 <= k <= p:
        raise ValueError(f"number of clusters must lie in 1…{p}, got {k}")
    keys = list(keys)

    def solve(found: pd.DataFrame) -> pd.DataFrame:
        labels = (segment_columns if contiguous else cluster_columns)(matrix_of(found, p), k)
        out = found[keys].head(1).copy()
        out["groups"] = [[np.flatnonzero(labels == c).tolist() for c in range(k)]]
        return out

    if cells is None:
        gram = grouped_gram(df, keys, columns, weight, center_rows=True)
    else:
        gram = cells.merge(grouped_gram(cells.rows, [CELL], columns, center_rows=True)).groupBy(*keys, "i", "j").agg(
            F.sum(F.col(WEIGHT) * F.col("v")).alias("v")
        )
    fields = [f"`{c}` {gram.schema[c].dataType.simpleString()}" for c in keys]
    return gram.groupBy(*keys).applyInPandas(solve, ", ".join([*fields, "groups array<array<int>>"]))


class SignalCompressor:
    """One compression per column list: cluster its columns, replace them by cluster values.

    Outputs are named ``compressed_{compression}_frame_{cluster}``, clusters in the order of
    their first column.
    """

    def __init__(self, n_clusters, input_columns, estimators, contiguous: bool = False):
        if not len(n_clusters) == len(input_columns) == len(estimators):
            raise ValueError("one cluster count, column list and estimator per compression")
        self.n_clusters = list(n_clusters)
        self.input_columns = [list(c) for c in input_columns]
        self.estimators = [estimator(e) for e in estimators]
        self.contiguous = contiguous

    def fit(self, df: DataFrame, keys=(), weight: str | None = None, cells: FitCells | None = None) -> CompressorModel:
        keyed = Keyed(keys)
        rows = keyed.add(df)
        groups = []
        for k, columns in zip(self.n_clusters, self.input_columns):
            require_columns(df, columns)
            own = cells if cells is not None and cells.n_cells <= MAX_GRAM_CELLS else None
            groups.append(settle(fit_groups(rows, keyed.keys, columns, k, weight, self.contiguous, own)))
        return CompressorModel(self, groups, keyed)


class CompressorModel:
    def __init__(self, compressor: SignalCompressor, groups, keyed):
        self.compressor, self.groups, self.keyed = compressor, groups, keyed
        self.dropped = [c for columns in compressor.input_columns for c in columns]
        self.names = {
            f"compression_{n}": {
                "original_names": columns,
                "compression_names": [f"compressed_{n}_frame_{g}" for g in range(1, k + 1)],
            }
            for n, (k, columns) in enumerate(zip(compressor.n_clusters, compressor.input_columns), start=1)
        }
        self.added = [c for entry in self.names.values() for c in entry["compression_names"]]

    def transform(self, df: DataFrame) -> DataFrame:
        df = self.keyed.add(df)
        for (name, entry), groups, value in zip(self.names.items(), self.groups, self.compressor.estimators):
            df = compress(df, groups, self.keyed.keys, entry["original_names"], entry["compression_names"], value)
        return self.keyed.remove(df)


def compress(df: DataFrame, groups: DataFrame, keys, columns, names, value) -> DataFrame:
    """Replace ``columns`` by one value per group of column positions, for all keys at once."""
    kept = [c for c in df.columns if c not in columns]
    joined = df.join(groups, list(keys)).select(
        *kept, "groups", F.array(*[F.col(c).cast("double") for c in columns]).alias("__frames")
    )
    values = F.transform(
        "groups", lambda g: value(F.transform(g, lambda i: F.get(F.col("__frames"), i)))
    )
    return joined.select(*kept, values.alias("__values")).select(
        *kept, *[F.get("__values", i).alias(name) for i, name in enumerate(names)]
    )
