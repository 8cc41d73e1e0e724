"""The study views over the test tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.catalog.registry import FRAMES
from strataloom.operators.subjects import roll_up_subjects


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fx_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject"),
        F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 4500, 1).otherwise(0).alias("target"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )


def fx_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve monthly frames per order; lines are summed before the join."""
    month = F.month("l_shipdate")
    frames = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        *[
            F.sum(F.when(month == m, F.col("l_quantity")).otherwise(0.0)).alias(name)
            for m, name in enumerate(FRAMES, start=1)
        ]
    )
    about = fx_orders(spark, folder).select("row_id", "subject", "segment", "target")
    return about.join(frames, "row_id")


def fx_vectors(spark: SparkSession, folder: str) -> DataFrame:
    subject = F.col("vec_id") % 50
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), subject.alias("subject"), (subject % 5).alias("site"),
        (subject % 2).cast("int").alias("target"), "embedding",
    )


def fx_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("subject"), "lang",
        F.col("quality").alias("target"), "n_chars",
    )


def fx_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("subject"), "event_type", "value",
        (F.col("user_id") % 2).cast("int").alias("target"),
    )


def subjects_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    return roll_up_subjects(fx_orders(spark, folder), "subject", ["segment", "target"])
