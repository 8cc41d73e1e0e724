"""Reading tables, tables kept in the shared folder, white space, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.materialize import ensure_checkpoint_dir

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back from there.

    Later reads do not depend on the executors that computed the rows, and prune columns.
    """
    path = shared_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_space(text: Column) -> Column:
    """Null as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def components(links: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``links`` (columns ``a, b``, both long).

    Each round sends every vertex to its smallest neighbour and contracts the links; the rounds
    are a logarithm of the component size as long as the numbers are in no particular order.
    Only minima are taken per vertex, so a hub is combined before the shuffle.
    """
    edges = keep(links.select("a", "b").where("a <> b").distinct())
    hops = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("m")))
        hops.append(hop)
        edges = keep(
            edges.join(hop.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a")
            .join(hop.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
            .where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct()
        )
    if not hops:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = hops.pop().select("v", F.col("m").alias("root"))
    while hops:
        up = roots.select(F.col("v").alias("m"), "root")
        roots = keep(hops.pop().join(up, "m", "left").select("v", F.coalesce("root", "m").alias("root")))
    return roots
