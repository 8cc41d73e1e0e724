"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataloom.catalog import QUERIES, views
from strataloom.catalog.models import study_settings
from strataloom.catalog.registry import FRAMES
from strataloom.operators import compress, metrics, sampling
from strataloom.plans.experiment import HoldoutExperiment

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def batches_100_by_1600(spark, folder):
    """Balanced batches of the published size, joined to their signals."""
    signals = views.fx_orders(spark, folder)
    made = sampling.generate_batches(signals, 100, 1600, "target", "row_id", ["amount"], seed=1)
    return sampling.fetch_rows(made.draws, signals, "row_id", made.n_rows_bound)


def compressor_fit_transform(spark, folder):
    frames = views.fx_frames(spark, folder)
    return compress.SignalCompressor([4], [FRAMES], ["median"]).fit(frames).transform(frames)


def holdout_study(spark, folder):
    """Ten folds; encode, scale, compress, 75 ridge and 25 tree nodes per fold, best 50 vote."""
    frames = views.fx_frames(spark, folder).select("row_id", *FRAMES)
    signals = views.fx_orders(spark, folder).join(frames, "row_id")
    settings = study_settings(
        ("Ridge", "tree"), (75, 25), ({"alpha": 1.2}, {"max_depth": 30, "max_features": 30, "min_samples_leaf": 30}),
        get_best=50, inputs=("priority", "amount"), encoders=True, frames=FRAMES,
    )
    return HoldoutExperiment(signals, settings, seed=1).run(10, 10)


def scored_auc(spark, folder):
    from strataloom.catalog.metrics import predicted

    return metrics.fold_auc(predicted(spark, folder), "y", "w")


BENCH = {
    "subject_rollup": QUERIES["subject_rollup"],
    "holdout_folds": QUERIES["holdout_folds"],
    "strata_folds_balanced": QUERIES["strata_folds_balanced"],
    "batches_100_by_1600": batches_100_by_1600,
    "batches_balanced_distinct": QUERIES["batches_balanced_distinct"],
    "one_hot": QUERIES["one_hot"],
    "target_encoding": QUERIES["target_encoding"],
    "min_max_scaling": QUERIES["min_max_scaling"],
    "mean_variance_scaling": QUERIES["mean_variance_scaling"],
    "column_gram": QUERIES["column_gram"],
    "compressor_fit_transform": compressor_fit_transform,
    "fold_auc": scored_auc,
    "ridge": QUERIES["ridge"],
    "ensemble_votes": QUERIES["ensemble_votes"],
    "leave_stratum_out_scores": QUERIES["leave_stratum_out_scores"],
    "stratified_scores": QUERIES["stratified_scores"],
    "holdout_study": holdout_study,
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    views.table(spark, SF_DIR, "orders").agg(F.sum("o_totalprice")).collect()
    only, seconds = sys.argv[1:], {}
    for name, run in BENCH.items():
        if only and name not in only:
            continue
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(sorted(taken)[len(taken) // 2], 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
