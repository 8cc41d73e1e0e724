"""Chains of transformers, fitted per fold on fit rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from strataloom.operators.cells import FitCells
from strataloom.operators.compress import SignalCompressor
from strataloom.operators.encode import OneHotEncoder, TargetEncoder
from strataloom.operators.scale import MinMaxScaler, StandardScaler

ENCODERS = {"one_hot": OneHotEncoder, "target_encoder": TargetEncoder}
NORMALIZERS = {"min_max_normalization": MinMaxScaler, "mean_var_normalization": StandardScaler}


def lookup(registry: dict, names) -> list:
    """Classes by name; the error lists the valid names."""
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise ValueError(f"unknown names {unknown}; valid: {sorted(registry)}")
    return [registry[n] for n in names]


@dataclass
class FittedChain:
    """Fitted steps in order; works on batch and streaming frames alike."""

    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def features(self, inputs) -> list[str]:
        """Input names after the chain: replaced columns out, new columns in."""
        names = list(inputs)
        for step in self.steps:
            names = [n for n in names if n not in step.dropped] + [n for n in step.added if n not in names]
        return names


@dataclass
class TransformerChain:
    """Steps with their own settings, columns and (for encoders) target column.

    ``steps`` are unfitted transformers with ``fit(df, keys, weight, target)``; each is
    fitted on the output of the ones before.
    """

    steps: list
    targets: list | None = None

    def fit(self, df: DataFrame, keys=(), weight: str | None = None, cells: FitCells | None = None) -> FittedChain:
        return FittedChain(self._fit(df, keys, weight, cells, set())[0])

    def _fit(self, df, keys, weight, cells, changed: set) -> tuple[list, DataFrame]:
        """Steps that read only columns no step has changed so far may use ``cells``."""
        fitted = []
        for n, step in enumerate(self.steps):
            if not hasattr(step, "fit"):
                raise TypeError(f"{type(step).__name__} has no fit method")
            target = self.targets[n] if self.targets else None
            raw = not changed & {*step.columns, target}
            model = step.fit(df, keys=keys, weight=weight, target=target, cells=cells if raw else None)
            fitted.append(model)
            changed |= {*step.columns, *model.added}
            df = model.transform(df)
        return fitted, df

    def fit_transform(self, df: DataFrame, keys=(), weight: str | None = None) -> DataFrame:
        return self.fit(df, keys, weight).transform(df)


def _chain(registry: dict, names, kwargs, columns, targets=None) -> TransformerChain:
    classes = lookup(registry, names)
    if not len(classes) == len(kwargs) == len(columns):
        raise ValueError("one settings map and one column list per transformer")
    return TransformerChain([c(columns=cols, **kw) for c, kw, cols in zip(classes, kwargs, columns)], targets)


def encoder_chain(names, kwargs, columns, targets=None) -> TransformerChain:
    return _chain(ENCODERS, names, kwargs, columns, targets or [None] * len(names))


def normalizer_chain(names, kwargs, columns) -> TransformerChain:
    return _chain(NORMALIZERS, names, kwargs, columns)


def fit_stages(fit_rows: DataFrame, keys, weight, encoders: TransformerChain | None,
               normalizers: TransformerChain | None, compressor: SignalCompressor | None,
               cells: FitCells | None = None) -> FittedChain:
    """Encode, normalise, compress; every stage sees the fit rows as the stages before left them.

    With ``cells`` the steps on raw columns read the signals once for all folds.
    """
    steps: list = []
    changed: set = set()
    for stage in (encoders, normalizers):
        if stage is not None and stage.steps:
            fitted, fit_rows = stage._fit(fit_rows, keys, weight, cells, changed)
            steps += fitted
    if compressor is not None and compressor.n_clusters:
        raw = not changed & {c for columns in compressor.input_columns for c in columns}
        steps.append(compressor.fit(fit_rows, keys, weight, cells if raw else None))
    return FittedChain(steps)
