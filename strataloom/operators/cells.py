"""One pass over the signals for the fit statistics of all folds.

Subjects with the same fit weights in every fold form a cell: with one fold per stratum a
cell is a stratum, with random hold-out most subjects share one cell. Statistics that can be
merged (counts, sums, extrema, moments, Gram matrices) are taken once per cell and then
merged per fold, so the work does not grow with the number of folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.materialize import BROADCAST_ROWS, pin, settle
from strataloom.operators.subjects import N_DRAWS, hot_subjects, join_members

CELL = "__cell"
WEIGHT = "__cell_weight"


@dataclass
class FitCells:
    """``rows``: raw signals with their cell; ``weights``: ``(cell, fold, weight)``."""

    rows: DataFrame
    weights: DataFrame
    n_cells: int

    def merge(self, partial: DataFrame) -> DataFrame:
        """Per-cell statistics repeated for the folds that use the cell."""
        return partial.join(self.weights, CELL)


def fit_cells(signals: DataFrame, folds: DataFrame, sizes: DataFrame, subject: str, row_key: str, rows: str) -> FitCells:
    """Cells of the fit side of ``folds``; ``sizes`` holds the rows per subject as ``rows``."""
    pattern = F.sort_array(F.collect_list(F.struct("fold", N_DRAWS)))
    subjects = pin(
        folds.filter("role = 'fit'").groupBy(subject).agg(pattern.alias("__pattern"))
        .withColumn(CELL, F.md5(F.to_json("__pattern"))).select(subject, CELL, "__pattern")
    )
    weights = settle(
        subjects.groupBy(CELL).agg(F.first("__pattern").alias("__pattern"))
        .select(CELL, F.inline("__pattern")).withColumnRenamed(N_DRAWS, WEIGHT)
    )
    members, hot = subjects.select(subject, CELL), None
    if members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    else:
        hot = hot_subjects(sizes, subject, rows)
    joined = join_members(signals, members, subject, row_key, hot)
    return FitCells(joined, weights, weights.select(CELL).distinct().count())
