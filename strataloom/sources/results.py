"""Saving finished experiments."""

from __future__ import annotations

import json
from datetime import datetime


# Fixed value: a saved study is named by its type and the local time in this format.
STAMP = "%Y-%m-%d_%H-%M-%S"


def result_name(experiment_type: str, now: datetime | None = None) -> str:
    stamp = (now or datetime.now()).strftime(STAMP)
    return f"{experiment_type}_{stamp}"


def save_experiment(experiment, path: str, name: str | None = None) -> str:
    """Write scores, predictions, nodes (with all they have learned) and settings under ``path/name``."""
    if experiment.stats is None:
        raise RuntimeError("the experiment has not run yet")
    base = f"{path}/{name or result_name(experiment.experiment_type)}"
    experiment.stats.write.parquet(f"{base}/stats")
    experiment.predictions.write.parquet(f"{base}/predictions")
    experiment.ensemble.nodes.write.parquet(f"{base}/nodes")
    settings = {"experiment_type": experiment.experiment_type, "seed": experiment.seed, **experiment.settings.raw}
    spark = experiment.stats.sparkSession
    text = json.dumps(settings, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/settings")
    return base
