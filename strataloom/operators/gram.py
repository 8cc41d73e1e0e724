"""Column Gram matrices per key: one pass, partial sums per task, no transpose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Partial matrices are handed on once they hold this many cells.
_FLUSH_CELLS = 4_000_000


def grouped_gram(df: DataFrame, keys, columns, weight: str | None = None, center_rows: bool = False) -> DataFrame:
    """Cells ``(keys, i, j, v)``, ``i <= j``, of ``XᵀWX`` over ``columns``, for each key.

    ``center_rows`` first subtracts each row's mean, which leaves distances between columns
    unchanged and keeps them accurate.
    """
    keys, columns = list(keys), list(columns)
    p = len(columns)
    upper = np.triu_indices(p)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def cells():
            for key, matrix in sums.items():
                out = pd.DataFrame({"i": upper[0].astype("int32"), "j": upper[1].astype("int32"), "v": matrix[upper]})
                for name, value in zip(keys, key):
                    out[name] = value
                yield out[[*keys, "i", "j", "v"]]

        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                x = pdf[columns].to_numpy(dtype=float)[rows]
                if np.isnan(x).any():
                    raise ValueError("missing values in the columns of a Gram matrix")
                if center_rows:
                    x = x - x.mean(axis=1, keepdims=True)
                xw = x * pdf[weight].to_numpy(dtype=float)[rows, None] if weight else x
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + xw.T @ x
            if len(sums) * p * p > _FLUSH_CELLS:
                yield from cells()
                sums.clear()
        yield from cells()

    key_fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    needed = df.select(*keys, *columns, *([weight] if weight else []))
    cells = needed.mapInPandas(partial, ", ".join([*key_fields, "i int", "j int", "v double"]))
    return cells.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def matrix_of(cells: pd.DataFrame, p: int) -> np.ndarray:
    """Symmetric matrix from its upper cells."""
    m = np.zeros((p, p))
    m[cells["i"], cells["j"]] = cells["v"]
    m[cells["j"], cells["i"]] = cells["v"]
    return m
