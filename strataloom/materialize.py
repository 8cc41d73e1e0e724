"""Cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# A hash relation of this many narrow parameter rows stays well below executor memory.
BROADCAST_ROWS = 200_000
# Tables up to this size may pass through the driver.
LOCAL_ROWS = 20_000
LOCAL_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; a folder of our own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(pinned: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the (already materialised) table has at most ``max_rows`` rows.

    Above that the plain table is returned and the join shuffles.
    """
    if pinned.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(pinned)
    log.info("table exceeds %d rows; joining by shuffle", max_rows)
    return pinned


def settle(df: DataFrame) -> DataFrame:
    """Compute a small table once: fitted parameters, node scores, fold weights.

    Up to ``LOCAL_ROWS`` rows and ``LOCAL_BYTES`` become a literal relation with a broadcast
    hint. Anything larger is pinned, and joined as its size allows.
    """
    rows = df.limit(LOCAL_ROWS + 1).toArrow()
    if rows.num_rows > LOCAL_ROWS or rows.nbytes > LOCAL_BYTES:
        return broadcast_if_small(pin(df))
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def pin_by(df: DataFrame, columns) -> DataFrame:
    """Like :func:`pin`, as a table partitioned by ``columns`` so that reads can prune."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.repartition(*columns).write.partitionBy(*columns).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
