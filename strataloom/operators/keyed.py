"""Fitting per key (fold) without a driver loop; no key means one group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.cells import CELL, FitCells

_ALL = "__all"


class Keyed:
    """Adds a constant key when there is none, and joins parameters back by key."""

    def __init__(self, keys=()):
        self.given = list(keys)
        self.keys = self.given or [_ALL]

    def add(self, df: DataFrame) -> DataFrame:
        return df if self.given else df.withColumn(_ALL, F.lit(0))

    def source(self, df: DataFrame, cells: FitCells | None) -> tuple[DataFrame, list[str]]:
        """Rows to take statistics from and their grouping: keyed fit rows, or cells of raw rows."""
        return (self.add(df), self.keys) if cells is None else (cells.rows, [CELL])

    def remove(self, df: DataFrame) -> DataFrame:
        return df if self.given else df.drop(_ALL)
