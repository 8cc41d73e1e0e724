"""Job functions for ``spark-submit``: data path, four settings files, optional save path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.config import StudySettings
from strataloom.plans.experiment import HoldoutExperiment, LeaveStratumOutExperiment, StratifiedExperiment
from strataloom.sources.results import save_experiment
from strataloom.sources.tables import read_signals


def _start(spark, kind, data, settings_paths, row_id, seed, schema):
    if schema is None and data.rstrip("/").lower().endswith(".csv"):
        raise ValueError("a CSV needs its schema: inferring it would read the table twice")
    signals = read_signals(spark, data, schema=schema, row_id=row_id)
    return kind(signals, StudySettings.load(*settings_paths), row_id, seed)


def _finish(experiment, save_path: str | None) -> DataFrame:
    """Save the results when asked to, else return the mean scores."""
    if save_path is not None:
        save_experiment(experiment, save_path)
        return experiment.stats
    return experiment.report()


def run_holdout(spark: SparkSession, data: str, settings_paths, n_folds: int = 10, test_set_size: int = 10,
                row_id: str = "row_id", save_path: str | None = None, seed=0, schema=None) -> DataFrame:
    experiment = _start(spark, HoldoutExperiment, data, settings_paths, row_id, seed, schema)
    experiment.run(n_folds, test_set_size)
    return _finish(experiment, save_path)


def run_leave_stratum_out(spark: SparkSession, data: str, settings_paths, loo_variable: str,
                          row_id: str = "row_id", save_path: str | None = None, seed=0, schema=None) -> DataFrame:
    experiment = _start(spark, LeaveStratumOutExperiment, data, settings_paths, row_id, seed, schema)
    experiment.run(loo_variable)
    return _finish(experiment, save_path)


def run_stratified(spark: SparkSession, data: str, settings_paths, strata_variable: str,
                   balanced_by: str | None = None, row_id: str = "row_id", save_path: str | None = None, seed=0,
                   schema=None) -> DataFrame:
    experiment = _start(spark, StratifiedExperiment, data, settings_paths, row_id, seed, schema)
    experiment.run(strata_variable, balanced_by)
    return _finish(experiment, save_path)
