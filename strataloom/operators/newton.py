"""Logistic regression and linear support vector classifiers for all folds and attempts together.

Both are fitted by Newton rounds. A round is one pass over the batches: every row's margin under the present
coefficients of its attempts is a column expression, and one weighted Gram matrix per (fold, attempt) then holds the
Hessian, the gradient and the loss. The step is a small solve per group. A group whose loss went up halves its
last step; a group at its optimum stops and is not passed again. The number of jobs is the number of rounds.

* ``logistic``: ``|w|^2 / 2 + C * sum log(1 + exp(-s f))``, ``s`` the class as -1 or 1.
* ``SVM``: ``|w|^2 / 2 + C * sum max(0, 1 - s f)^2``; its Hessian is the Gram matrix of the rows within the margin.

The intercept carries no penalty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.materialize import broadcast_if_small, settle
from strataloom.operators.gram import grouped_gram, matrix_of

MAX_ROUNDS = 100
# A group stops once a full step would gain less than this share of its loss; that step is still taken.
GAIN = 1e-13
_HALVINGS = 40
_FLAT = 1e-12


def _logistic(s: Column, f: Column) -> tuple[Column, Column, Column]:
    """Curvature, slope and loss of one row as functions of the margin."""
    z = s * f
    tail = F.exp(-F.abs(z))
    loss = F.when(z > 0, F.log1p(tail)).otherwise(F.log1p(tail) - z)
    missed = F.when(z > 0, tail / (1 + tail)).otherwise(1 / (1 + tail))
    return F.greatest(tail / ((1 + tail) * (1 + tail)), F.lit(_FLAT)), -s * missed, loss


def _squared_hinge(s: Column, f: Column) -> tuple[Column, Column, Column]:
    short = F.greatest(1 - s * f, F.lit(0.0))
    return F.when(short > 0, 2.0).otherwise(0.0), -2 * s * short, short * short


LOSSES = {"logistic": _logistic, "SVM": _squared_hinge}


def _step(p: int):
    def run(cells: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return state
        now = state.iloc[0].to_dict()
        if not len(cells):
            raise ValueError(f"attempt {now['attempt']} of fold {now['fold']}: no rows")
        m, c = matrix_of(cells, p + 3), now["c"]
        coef = np.array(now["coef"])
        penalty = np.ones(p + 1)
        penalty[0] = 0.0
        loss = c * m[0, p + 2] + 0.5 * float((penalty * coef * coef).sum())
        last = now["loss"]
        if last is not None and not np.isnan(last) and loss > last + 1e-12 * abs(last) and now["halved"] < _HALVINGS:
            now.update(coef=((coef + np.array(now["before"])) / 2).tolist(), halved=now["halved"] + 1)
        else:
            hessian, slope = c * m[: p + 1, : p + 1] + np.diag(penalty), c * m[: p + 1, p + 1] + penalty * coef
            free = slice(0, None) if now["fit_intercept"] else slice(1, None)
            move = np.zeros(p + 1)
            move[free] = np.linalg.lstsq(hessian[free, free], -slope[free], rcond=1e-15)[0]
            stop = -float(slope @ move) <= GAIN * max(abs(loss), 1e-300)
            now.update(coef=(coef + move).tolist(), before=coef.tolist(), loss=loss, halved=0, done=bool(stop))
        now["rounds"] += 1
        now["done"] = bool(now["done"] or now["rounds"] >= now["max_iter"])
        return pd.DataFrame([now])[list(state.columns)]

    return run


def fit_linear(kind: str, rows: DataFrame, tries: DataFrame, features, target: str = "y", fold_type: str = "int") -> DataFrame:
    """``fold, attempt, intercept, coef`` for ``tries`` (``fold, attempt, batch, c, fit_intercept, max_iter``) on ``rows`` (``fold, batch``)."""
    features = list(features)
    p = len(features)
    fields = (f"fold {fold_type}, attempt bigint, batch bigint, c double, fit_intercept boolean, max_iter int, coef array<double>, "
              "before array<double>, loss double, halved int, rounds int, done boolean")
    zeros = F.array_repeat(F.lit(0.0), p + 1)
    state = settle(tries.select(
        "fold", F.col("attempt").cast("bigint").alias("attempt"), F.col("batch").cast("bigint").alias("batch"), F.col("c").cast("double").alias("c"), "fit_intercept",
        F.col("max_iter").cast("int").alias("max_iter"), zeros.alias("coef"), zeros.alias("before"), F.lit(None).cast("double").alias("loss"),
        F.lit(0).alias("halved"), F.lit(0).alias("rounds"), F.lit(False).alias("done")))
    finished, keys = [], ["fold", "attempt"]
    while True:
        finished.append(state.where("done"))
        state = state.where("not done")
        if state.isEmpty():
            break
        now = broadcast_if_small(state.select("fold", "batch", "attempt", "coef"))
        margin = F.get("coef", F.lit(0))
        for i, c in enumerate(features):
            margin = margin + F.col(c).cast("double") * F.get("coef", F.lit(i + 1))
        met = rows.join(now, ["fold", "batch"]).select(
            *keys, *[F.col(c).cast("double").alias(c) for c in features], (2.0 * F.col(target) - 1).alias("__s"), margin.alias("__f"))
        weight, slope, loss = LOSSES[kind](F.col("__s"), F.col("__f"))
        met = met.select(*keys, *features, weight.alias("__h"), slope.alias("__g"), loss.alias("__l"))
        shown = met.select(*keys, F.lit(1.0).alias("__one"), *features, *[
            F.when(F.col("__h") > 0, F.col(c) / F.col("__h")).otherwise(0.0).alias(c) for c in ("__g", "__l")], "__h")
        cells = grouped_gram(shown, keys, ["__one", *features, "__g", "__l"], "__h")
        state = settle(cells.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(_step(p), fields))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return settle(out.select("fold", "attempt", F.get("coef", F.lit(0)).alias("intercept"), F.slice("coef", 2, p).alias("coef")))
