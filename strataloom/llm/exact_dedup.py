"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted on disk; rows with equal
bytes then stand next to each other, and the window over full texts compares neighbours and keeps
the smallest identifier. The splitters see a bounded key (a prefix and a hash that parts texts with
a common prefix), so the sample that Spark takes of it stays small whatever the text lengths.

A text that holds more than 1/256 of all rows is spread over salts; its sorted runs are merged
afterwards. At most 256 hashes can be that frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import keep, one_space

PREFIX = 48
HOT_SHARE = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. Null identifiers come last: ``keep_id`` is null only if the whole
    group has none. Of rows that repeat identifier and text exactly one is kept. An empty table
    gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), one_space(F.col(text_col)).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("p", F.substring("t", 1, PREFIX))
    share = rows.count() / HOT_SHARE
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > F.lit(max(share, 64.0))).collect()  # at most HOT_SHARE rows
    salt, key = F.lit(0), ["p", "h", "s"] if hot else ["p", "h"]  # a constant would cost another shuffle
    for row in hot:
        salts = int(row["n"] / max(share, 64.0)) + 1
        salt = F.when(F.col("h") == row["h"], F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int") + 1).otherwise(salt)
    run = Window.partitionBy(*key, "t")
    runs = (
        rows.withColumn("s", salt).repartitionByRange(*key)
        .withColumn("rank", F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last())))
        .withColumn("keep_id", F.min("doc_id").over(run))
        .withColumn("n", F.count(F.lit(1)).over(run))
        .select("doc_id", "keep_id", "n", "rank", "s", F.sha2("t", 256).alias("text_sha256"))
    )
    if not hot:
        return _result(runs)
    runs = keep(runs)
    merged = (
        runs.where("s > 0 and rank = 1").groupBy("text_sha256")
        .agg(F.min("keep_id").alias("all_id"), F.sum("n").alias("all_n"))
    )
    # one row per hot text: no more than HOT_SHARE
    joined = runs.where("s > 0").join(F.broadcast(merged), "text_sha256")
    joined = joined.withColumn("rank", F.when(F.col("keep_id").eqNullSafe(F.col("all_id")), F.col("rank")))
    joined = joined.withColumn("keep_id", F.col("all_id")).withColumn("n", F.col("all_n"))
    return _result(runs.where("s = 0")).unionByName(_result(joined))


def _result(runs: DataFrame) -> DataFrame:
    return runs.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        F.coalesce(F.col("rank") == 1, F.lit(False)).alias("kept"), "text_sha256",
    )
