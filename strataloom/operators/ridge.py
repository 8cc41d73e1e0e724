"""Ridge classifiers for many batches and penalties at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.gram import grouped_gram, matrix_of


def ridge_grams(batches: DataFrame, keys, features, target: str, weight: str | None = None) -> DataFrame:
    """Gram cells of ``[1, features…, ±1 target]`` per key; all a ridge fit needs."""
    signed = (F.col(target).cast("double") * 2 - 1).alias("__y")
    rows = batches.select(
        *keys, F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in features], signed,
        *([weight] if weight else []),
    )
    return grouped_gram(rows, keys, ["__one", *features, "__y"], weight)


def _solve(gram: np.ndarray, alpha: float, intercept: bool = True) -> tuple[float, np.ndarray]:
    """Coefficients of least squares with penalty ``alpha``; the intercept is free, or 0."""
    n = gram[0, 0]
    mean_x, mean_y = (gram[0, 1:-1] / n, gram[0, -1] / n) if intercept else (np.zeros(len(gram) - 2), 0.0)
    xx = gram[1:-1, 1:-1] - n * np.outer(mean_x, mean_x)
    xy = gram[1:-1, -1] - n * mean_x * mean_y
    penalised = xx + alpha * np.eye(len(xx))
    try:
        coef = np.linalg.solve(penalised, xy)
    except np.linalg.LinAlgError:
        coef = np.linalg.lstsq(penalised, xy, rcond=None)[0]
    return float(mean_y - mean_x @ coef), coef


def solve_ridge(grams: DataFrame, attempts: DataFrame, keys, n_features: int) -> DataFrame:
    """Adds ``intercept`` and ``coef`` to attempts ``(keys, alpha[, fit_intercept], …)``; one small solve each."""
    keys = list(keys)
    size = n_features + 2

    def solve(cells: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
        gram = matrix_of(cells, size) if len(cells) else None
        free = tries["fit_intercept"] if "fit_intercept" in tries else [True] * len(tries)
        fitted = [
            _solve(gram, a, bool(i)) if gram is not None else (np.nan, np.full(n_features, np.nan)) for a, i in zip(tries["alpha"], free)
        ]
        return tries.assign(intercept=[f[0] for f in fitted], coef=[f[1].tolist() for f in fitted])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema.fields]
    schema = ", ".join([*fields, "intercept double", "coef array<double>"])
    return grams.groupBy(*keys).cogroup(attempts.groupBy(*keys)).applyInPandas(solve, schema)


def linear_vote(features, intercept: Column, coef: Column) -> Column:
    """1 where the linear decision is positive."""
    total = intercept
    for i, c in enumerate(features):
        total = total + F.col(c).cast("double") * F.get(coef, F.lit(i))
    return (total > 0).cast("int")


def score_linear(nodes: DataFrame, batches: DataFrame, on: dict, features, target: str, out: str) -> DataFrame:
    """Accuracy of each node on one batch; ``on`` maps node columns to batch columns."""
    renamed = batches.select(
        *[F.col(b).alias(n) for n, b in on.items()], *features, F.col(target).alias("__y")
    )
    vote = linear_vote(features, F.col("intercept"), F.col("coef"))
    return (
        renamed.join(nodes.select(*dict.fromkeys([*on, "fold", "attempt"]), "intercept", "coef"), list(on))
        .select("fold", "attempt", (vote == F.col("__y")).cast("double").alias("__hit"))
        .groupBy("fold", "attempt")
        .agg(F.avg("__hit").alias(out))
    )
