"""Saving and loading batch sets."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strataloom.operators.sampling import Sampling

FORMATS = ("parquet", "json")


# Draws that one task writes of one batch, on average.
FILE_DRAWS = 2_000_000


def save_sampling(sampling: Sampling, path: str, name: str, mode: str = "parquet", file_draws: int = FILE_DRAWS) -> None:
    """Write draws, one folder per batch, and the settings beside them; long batches are written by several tasks."""
    if mode not in FORMATS:
        raise ValueError(f"unknown mode {mode!r}; valid: {FORMATS}")
    if sampling.n_batches < 1:
        raise ValueError("nothing sampled yet")
    base = f"{path}/{name}"
    parts = max(1, -(-sampling.n_rows_bound // (sampling.n_batches * file_draws)))
    part = F.pmod(F.xxhash64(sampling.row_id), F.lit(parts))
    writer = sampling.draws.repartition(*(["batch", part] if parts > 1 else ["batch"])).write.partitionBy("batch")
    getattr(writer, mode)(f"{base}.{mode}")
    about = {
        "row_id": sampling.row_id,
        "row_id_type": dict(sampling.draws.dtypes)[sampling.row_id],
        "target": sampling.target,
        "inputs": list(sampling.inputs),
        "n_batches": sampling.n_batches,
        "balanced": sampling.balanced,
        "resample": sampling.resample,
        "n_rows_bound": sampling.n_rows_bound,
    }
    spark = sampling.draws.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{base}.{mode}.settings")


def load_sampling(spark: SparkSession, path: str, name: str) -> Sampling:
    """Read a batch set back; Parquet is preferred to JSON when both exist."""
    for mode in FORMATS:
        base = f"{path}/{name}.{mode}"
        try:
            about = json.loads(spark.read.text(f"{base}.settings").first()[0])
        except AnalysisException:
            continue
        schema = f"`{about['row_id']}` {about.pop('row_id_type')}, batch int"
        reader = spark.read.schema(schema)
        draws = getattr(reader, mode)(base).select("batch", about["row_id"])
        return Sampling(draws=draws, **about)
    raise FileNotFoundError(f"no sampling {name!r} under {path}")
