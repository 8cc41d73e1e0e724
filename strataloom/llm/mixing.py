"""Mixing sources to target weights by pivotal dependent rounding.

A source of size ``s`` (words) with target ``t`` wants every document ``q = t / s`` times. Each
document gets ``floor(q)`` copies and, with probability ``q - floor(q)``, one more. The extra copies
are drawn dependently: two documents with fractional probabilities exchange mass, measured in words,
until one of them is 0 or 1; the direction is random so that probabilities are kept in expectation
and the words of the pair are kept exactly. One fractional document is left of each block. These
residuals meet in blocks again, level by level, until a source has one, which is rounded to the
nearer side. A source thus misses its target by at most half of one document.

Blocks and directions follow from hashes of the rows, so that reruns agree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import keep, n_words

BLOCK = 2048  # documents that one task rounds together


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources in code point order, null last, take the weights in turn. Targets share the sum of all
    sizes; what exceeds ``most`` times a source's size is shared again by weight among the others.
    """
    n = sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # ranks over all sources: sorted runs, then the number of sources in the runs before
    runs = keep(
        sizes.withColumn("none", F.col("source").isNull()).repartitionByRange(int(n), "none", "source")
        .sortWithinPartitions("none", "source")
        .withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    )
    # the lower 33 bits of the identifier count rows within the partition
    runs = runs.withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    lengths = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = lengths.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("before") + F.col("at")) % len(weights) + 1).cast("int"))
    weighed = keep(runs.join(before, "run").select("source", "source_size", turn.alias("w")))
    total, left, open_w = weighed.agg(F.sum("source_size"), F.sum("source_size"), F.sum("w")).first()
    if not total:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    level, last = left / open_w, None  # words per unit of weight
    while level != last:
        last = level
        full = F.col("w") * F.lit(level) > most * F.col("source_size")
        capped, open_w = weighed.agg(
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))),
        ).first()
        level = (total - capped) / open_w if open_w else math.inf
    return weighed.select(
        "source", "source_size", F.least(F.col("w") * F.lit(level), most * F.col("source_size")).alias("target"),
    )


def _draws(seed: int, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Random numbers that depend on the content of the block alone."""
    digest = hashlib.sha256(order.astype("<i8").tobytes() + size.astype("<i8").tobytes()).digest()
    return np.random.default_rng([seed, int.from_bytes(digest[:8], "little")]).random(len(size))


def pivotal(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded probabilities and the position of the one that stays fractional (-1: none).

    Neighbours exchange words: ``sum(p * size)`` is kept. Sizes must be positive.
    """
    p, held = p.copy(), -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        up = min((1.0 - p[i]) * a, p[j] * b)  # words that i can take from j
        down = min(p[i] * a, (1.0 - p[j]) * b)
        words = up if draws[j] * (up + down) < down else -down
        full = words > 0
        # whichever bound was met is set exactly
        first = ((1.0 - p[i]) * a <= p[j] * b) if full else (p[i] * a <= (1.0 - p[j]) * b)
        if first:
            p[j] = min(1.0, max(0.0, p[j] - words / b))
            p[i], held = (1.0 if full else 0.0), j
            if p[j] in (0.0, 1.0):
                held = -1
        else:
            p[i] = min(1.0, max(0.0, p[i] + words / a))
            p[j] = 0.0 if full else 1.0
            if p[i] in (0.0, 1.0):
                held = -1
    return p, held


def mix_plan(rows: DataFrame, targets: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (``id, source, size, order``) with ``source_size, target, copies``.

    ``counts``: ``source, n`` rows of every source.

    ``order`` is a long hash of the row that spreads rows over blocks. Documents without words are
    not drawn: they get ``floor`` copies, or their source's probability by their hash.
    """
    known = targets.select(F.col("source").alias("_s"), "source_size", "target")  # Spark broadcasts it if small
    open_ = rows.join(known, rows["source"].eqNullSafe(known["_s"])).drop("_s")
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    open_ = open_.withColumn("base", F.floor(q).cast("long")).withColumn("p", q - F.floor(q)).withColumn("level", F.lit(0))
    counts = counts.select(F.col("source").alias("_s"), F.col("n").alias("_n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK)).cast("long")
    open_ = open_.join(counts, open_["source"].eqNullSafe(counts["_s"])).withColumn("block", F.pmod("order", blocks))
    open_ = open_.withColumn("blocks", blocks).drop("_s", "_n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema)

    def settle(part: pa.Table) -> pa.Table:
        size, order = part["size"].to_numpy(), part["order"].to_numpy()
        at = np.lexsort((order, -size))
        part, size, order = part.take(pa.array(at)), size[at], order[at]
        p, base, draws = part["p"].to_numpy().copy(), part["base"].to_numpy(), _draws(seed, size, order)
        empty = size == 0
        p[empty] = draws[empty] < p[empty]
        p, held = pivotal(p, size.astype(float), draws)
        block, blocks, level = part["block"].to_numpy(), part["blocks"].to_numpy(), part["level"].to_numpy()
        if blocks[0] == 1 and held >= 0:
            p[held] = float(p[held] >= 0.5)
        done = (p == 0.0) | (p == 1.0)
        new = {
            "p": p, "base": base + np.where(done, p, 0.0).astype(np.int64), "level": np.where(done, -1, level + 1).astype(np.int32),
            "block": np.where(done, block, block // BLOCK), "blocks": np.where(done, blocks, -(-blocks // BLOCK)),
        }
        for name, values in new.items():
            part = part.set_column(part.schema.get_field_index(name), name, pa.array(values))
        return part

    done = None
    while True:  # the number of levels is the logarithm, to base BLOCK, of the largest source
        level = keep(open_.groupBy("source", "block").applyInArrow(settle, schema))
        rounded = level.where("level < 0")
        done = rounded if done is None else done.unionByName(rounded)
        open_ = level.where("level >= 0")
        if open_.isEmpty():
            break
    return done.select("id", "source", "size", "order", "source_size", "target", F.col("base").alias("copies"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, order, copies``.

    ``copies`` is how often the mix takes the document, at most ``ceil(most)`` times. Null and blank
    texts have size 0; a table without words has targets and copies of 0. Null is a source of its
    own, after all others. Rows that repeat identifier and text are documents of their own. Other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("order"),
    )
    rows = keep(rows)
    sources = keep(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    targets = source_targets(sources.drop("n"), weights, most)
    return mix_plan(rows, targets, sources.drop("source_size"), seed).withColumnRenamed("id", "doc_id")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id, text, source``), each as often as the mix takes it."""
    twin = Window.partitionBy("_id", "_order", "_source").orderBy("_order")  # rows alike in all three are interchangeable
    plan = mix(docs, weights, most, seed).select(
        F.col("doc_id").alias("_id"), F.col("order").alias("_order"), F.col("source").alias("_source"), "copies",
    ).withColumn("_twin", F.row_number().over(twin))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("_order"),
        F.col("source").alias("_source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    ).withColumn("_twin", F.row_number().over(twin))
    same = [rows[c].eqNullSafe(plan[c]) for c in ("_id", "_order", "_source", "_twin")]
    taken = rows.join(plan.where("copies > 0"), same[0] & same[1] & same[2] & same[3])
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
