"""Column builders: seeded hashing and row estimators."""

from strataloom.functions.estimators import ESTIMATORS, estimator, estimators
from strataloom.functions.hashing import hash60, uniform

__all__ = ["ESTIMATORS", "estimator", "estimators", "hash60", "uniform"]
