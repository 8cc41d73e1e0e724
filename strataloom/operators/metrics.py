"""Votes, thresholds and weighted scores per fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_BUCKETS = 4096


def vote_share(votes: DataFrame, by=("fold", "row_id")) -> DataFrame:
    """Mean of the 0/1 votes of all nodes, per row."""
    return votes.groupBy(*by).agg(F.avg("vote").alias("proba"))


def check_threshold(threshold: float) -> None:
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must lie strictly between 0 and 1")


def classify(df: DataFrame, threshold: float, proba: str = "proba", out: str = "pred") -> DataFrame:
    """1 where the vote share is strictly above the threshold."""
    return df.withColumn(out, (F.col(proba) > F.lit(threshold)).cast("int"))


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _rate(hit: Column, given: Column, w: Column) -> Column:
    """Weighted share of ``hit`` among rows where ``given``; null when there are none."""
    wrong = F.sum(F.when(given & hit, w).otherwise(0.0))
    return F.try_divide(wrong, F.sum(F.when(given, w).otherwise(0.0)))


def fold_rates(scored: DataFrame, target: str = "target", weight: str | None = None, by=("fold",)) -> DataFrame:
    """Accuracy, false-negative and false-positive rate; null rates when a class is absent."""
    w, y, p = _weight(weight), F.col(target), F.col("pred")
    return scored.groupBy(*by).agg(
        _rate(p == y, y.isNotNull(), w).alias("accuracy"),
        _rate(p == 0, y == 1, w).alias("fnr"),
        _rate(p == 1, y == 0, w).alias("fpr"),
    )


def fold_auc(scored: DataFrame, target: str = "target", weight: str | None = None, by=("fold",)) -> DataFrame:
    """ROC AUC with ties averaged; null when a class is absent.

    Rows are first summed per distinct score. Running sums over the scores go in two
    levels (score bucket, then score), so that no window holds all scores of a fold.
    """
    by, w, y = list(by), _weight(weight), F.col(target)
    at_score = (
        scored.groupBy(*by, "proba")
        .agg(
            F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"),
            F.sum(F.when(y == 0, w).otherwise(0.0)).alias("neg"),
        )
        .withColumn("__bucket", F.floor(F.col("proba") * SCORE_BUCKETS))
    )
    buckets = at_score.groupBy(*by, "__bucket").agg(F.sum("neg").alias("__neg"))
    over_buckets = Window.partitionBy(*by).orderBy("__bucket")
    buckets = buckets.select(*by, "__bucket", (F.sum("__neg").over(over_buckets) - F.col("__neg")).alias("__below"))
    in_bucket = Window.partitionBy(*by, "__bucket").orderBy("proba")
    ranked = at_score.join(buckets, [*by, "__bucket"]).withColumn(
        "__below", F.col("__below") + F.sum("neg").over(in_bucket) - F.col("neg")
    )
    return ranked.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")
        ).alias("roc_auc")
    )


def strata_auc(scored: DataFrame, target: str = "target", weight: str | None = None, by=("fold",)) -> DataFrame:
    """ROC AUC, replaced by accuracy in folds with one class only."""
    rates = fold_rates(scored, target, weight, by)
    return fold_auc(scored, target, weight, by).join(rates, list(by)).select(
        *by, F.coalesce("roc_auc", "accuracy").alias("roc_auc")
    )


def strata_weight(members: DataFrame, weight: str | None = None, by=("fold",)) -> DataFrame:
    """Share of validation rows among all rows of the fold."""
    w = _weight(weight)
    return members.groupBy(*by).agg(
        (F.sum(F.when(F.col("role") == "val", w).otherwise(0.0)) / F.sum(w)).alias("strata_weight")
    )


def report(stats: DataFrame, columns) -> DataFrame:
    """Unweighted mean of each score over the folds; missing scores are skipped."""
    return stats.agg(*[F.avg(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in columns])
