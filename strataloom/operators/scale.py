"""Column scalers, fitted per key on fit rows; columns are replaced in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.materialize import settle
from strataloom.operators.cells import WEIGHT, FitCells
from strataloom.operators.keyed import Keyed
from strataloom.operators.settings import reject_unknown
from strataloom.operators.subjects import require_columns


def _number(column: str) -> Column:
    """NaN as null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


class MinMaxScaler:
    """Maps the fit range of each column to ``feature_range``.

    A constant column maps to the lower bound. Values outside the fit range are clipped only with ``clip``.
    Null and NaN count as missing.
    """

    def __init__(self, columns, feature_range=(0.0, 1.0), clip: bool = False, **other):
        reject_unknown("min_max_normalization", other, ("feature_range", "clip"))
        low, high = map(float, feature_range)
        if not low < high:
            raise ValueError("feature_range must be increasing")
        self.columns, self.low, self.high, self.clip = list(columns), low, high, clip

    def fit(self, df: DataFrame, keys=(), weight: str | None = None, target: str | None = None,
            cells: FitCells | None = None) -> ScalerModel:
        keyed = Keyed(keys)
        df, by = keyed.source(df, cells)
        require_columns(df, self.columns)
        at = range(len(self.columns))
        limits = df.groupBy(*by).agg(
            *[F.min(_number(c)).alias(f"__low_{i}") for i, c in enumerate(self.columns)],
            *[F.max(_number(c)).alias(f"__high_{i}") for i, c in enumerate(self.columns)],
        )
        if cells is not None:
            limits = cells.merge(limits).groupBy(*keyed.keys).agg(
                *[F.min(f"__low_{i}").alias(f"__low_{i}") for i in at],
                *[F.max(f"__high_{i}").alias(f"__high_{i}") for i in at],
            )
        limits = limits.select(
            *keyed.keys,
            *[F.col(f"__low_{i}").alias(f"__shift_{i}") for i in at],
            *[(F.col(f"__high_{i}") - F.col(f"__low_{i}")).alias(f"__scale_{i}") for i in at],
        )
        return ScalerModel(self.columns, settle(limits), keyed, self.high - self.low, self.low, self.clip)


class StandardScaler:
    """Subtracts the mean and divides by the population standard deviation (1 when that is 0)."""

    def __init__(self, columns, with_mean: bool = True, with_std: bool = True, **other):
        reject_unknown("mean_var_normalization", other, ("with_mean", "with_std"))
        self.columns, self.with_mean, self.with_std = list(columns), with_mean, with_std

    def fit(self, df: DataFrame, keys=(), weight: str | None = None, target: str | None = None,
            cells: FitCells | None = None) -> ScalerModel:
        keyed = Keyed(keys)
        df, by = keyed.source(df, cells)
        require_columns(df, self.columns)
        df = df.select(*by, *self.columns, *([weight] if weight and cells is None else []))
        at = range(len(self.columns))
        # rows of one weight share their moments; weights multiply the counts when these are merged
        weighted = weight is not None and cells is None
        df = df.withColumnRenamed(weight, WEIGHT) if weighted else df
        moments = df.groupBy(*by, *([WEIGHT] if weighted else [])).agg(
            *[F.count(_number(c)).alias(f"__n_{i}") for i, c in enumerate(self.columns)],
            *[F.avg(_number(c)).alias(f"__mean_{i}") for i, c in enumerate(self.columns)],
            *[F.var_pop(_number(c)).alias(f"__var_{i}") for i, c in enumerate(self.columns)],
        )
        if cells is not None:
            moments = self._merged(cells.merge(moments), keyed.keys)
        elif weighted:
            moments = self._merged(moments, by)
        moments = moments.select(
            *keyed.keys,
            *[(F.col(f"__mean_{i}") if self.with_mean else F.lit(0.0)).alias(f"__shift_{i}") for i in at],
            *[(F.sqrt(f"__var_{i}") if self.with_std else F.lit(1.0)).alias(f"__scale_{i}") for i in at],
        )
        return ScalerModel(self.columns, settle(moments), keyed, 1.0, 0.0)

    def _merged(self, parts: DataFrame, keys) -> DataFrame:
        """Moments of unions of cells: spread within the cells plus spread of their means."""
        at = range(len(self.columns))
        times = [F.col(WEIGHT) * F.col(f"__n_{i}") for i in at]
        centers = parts.groupBy(*keys).agg(
            *[(F.sum(times[i] * F.col(f"__mean_{i}")) / F.sum(times[i])).alias(f"__center_{i}") for i in at]
        )
        apart = [F.col(f"__mean_{i}") - F.col(f"__center_{i}") for i in at]
        return parts.join(centers, keys).groupBy(*keys).agg(
            *[F.first(f"__center_{i}").alias(f"__mean_{i}") for i in at],
            *[
                (F.sum(times[i] * (F.col(f"__var_{i}") + apart[i] * apart[i])) / F.sum(times[i])).alias(f"__var_{i}")
                for i in at
            ],
        )


class ScalerModel:
    added: list = []
    dropped: list = []

    def __init__(self, columns, params, keyed, span, low, clip: bool = False):
        self.columns, self.params, self.keyed, self.span, self.low, self.clip = columns, params, keyed, span, low, clip

    def transform(self, df: DataFrame) -> DataFrame:
        at = {c: i for i, c in enumerate(self.columns)}
        joined = self.keyed.add(df).join(self.params, self.keyed.keys)
        scale = [F.when(F.col(f"__scale_{i}") == 0, 1.0).otherwise(F.col(f"__scale_{i}")) for i in at.values()]

        def scaled(c: str) -> Column:
            value = (F.col(c) - F.col(f"__shift_{at[c]}")) / scale[at[c]] * self.span + self.low
            if self.clip:  # missing values stay missing
                value = F.when(value < self.low, self.low).when(value > self.low + self.span, self.low + self.span).otherwise(value)
            return value.alias(c)

        return joined.select(*[scaled(c) if c in at else F.col(c) for c in df.columns])
