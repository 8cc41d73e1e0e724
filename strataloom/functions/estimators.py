"""Row estimators over an array of frame values; nulls are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RowEstimator = Callable[[Column], Column]


def _present(values: Column) -> Column:
    return F.array_compact(values)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def row_sum(values: Column) -> Column:
    """Sum of the values present; 0 when there are none."""
    return _total(_present(values))


def row_mean(values: Column) -> Column:
    """Mean of the values present; null when there are none."""
    kept = _present(values)
    return F.try_divide(_total(kept), F.size(kept))


def row_median(values: Column) -> Column:
    """Median of the values present; null when there are none."""
    kept = F.sort_array(_present(values))
    n = F.size(kept)
    lower = F.get(kept, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(kept, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def row_std(values: Column) -> Column:
    """Population standard deviation of the values present; null when there are none."""
    kept = _present(values)
    n = F.size(kept)
    # second fold over the deviations keeps the result accurate for large offsets
    moments = F.aggregate(
        kept,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda acc, x: F.struct(
            (acc["n"] + 1.0).alias("n"),
            (acc["mean"] + (x - acc["mean"]) / (acc["n"] + 1.0)).alias("mean"),
            (
                acc["m2"]
                + (x - acc["mean"]) * (x - (acc["mean"] + (x - acc["mean"]) / (acc["n"] + 1.0)))
            ).alias("m2"),
        ),
        lambda acc: acc["m2"],
    )
    return F.when(n > 0, F.sqrt(moments / n))


ESTIMATORS: dict[str, RowEstimator] = {
    "mean": row_mean,
    "median": row_median,
    "std": row_std,
    "sum": row_sum,
}


def estimator(name_or_function: str | RowEstimator) -> RowEstimator:
    """Estimator by name, or any function from an array column to a column."""
    if callable(name_or_function):
        return name_or_function
    if name_or_function not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name_or_function!r}; valid: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name_or_function]


def estimators(names) -> list[RowEstimator]:
    return [estimator(n) for n in names]
