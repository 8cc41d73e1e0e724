"""Score a stream of signals with a fitted chain and ensemble.

Fitted transformers and shipped nodes (linear, trees) are stateless per row, so the batch
plan is used as it is. Nearest neighbours need a shuffle per row and are not offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.ensemble import FittedEnsemble
from strataloom.operators.transform import FittedChain


def score_stream(signals: DataFrame, ensemble: FittedEnsemble, chain: FittedChain | None = None,
                 threshold: float = 0.5) -> DataFrame:
    """Adds ``proba`` and ``pred`` to every signal as it arrives."""
    if ensemble.nodes.filter(F.col("kind") == "knn").limit(1).count():
        raise ValueError("nearest-neighbour nodes cannot score a stream")
    return ensemble.predict(chain.transform(signals) if chain else signals, threshold)
