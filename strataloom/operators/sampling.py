"""Batch sets: draw tables that name signals instead of copying them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.hashing import hash60
from strataloom.materialize import broadcast_if_small, pin
from strataloom.operators.draws import (
    DRAWS_BROADCAST,
    draw_with_replacement,
    draw_without_replacement,
    group_sizes,
    index_rows,
)
from strataloom.operators.subjects import require_binary, require_columns


def resolve_variables(df: DataFrame, target: str, inputs=None) -> list[str]:
    """Input columns: the given ones or all columns, without the target."""
    require_columns(df, [target])
    chosen = list(df.columns if inputs is None else inputs)
    require_columns(df, chosen)
    return [c for c in chosen if c != target]


def same_variables(a, b) -> bool:
    return set(a) == set(b)


@dataclass(frozen=True)
class Sampling:
    """Draw table ``(batch, row_id)`` with the settings it was made from."""

    draws: DataFrame
    row_id: str
    target: str
    inputs: list[str]
    n_batches: int
    balanced: bool
    resample: bool
    n_rows_bound: int = field(default=0)

    def extract_batch(self, signals: DataFrame, index: int, y: bool = False) -> DataFrame:
        """Inputs (or the target) of one batch, with ``row_id``; repeated draws repeat rows."""
        if not 0 <= index < self.n_batches:
            raise IndexError(f"batch {index} out of range; there are {self.n_batches}")
        wanted = [self.target] if y else self.inputs
        require_columns(signals, [self.row_id, *wanted])
        batch = self.draws.filter(F.col("batch") == index)
        return fetch_rows(batch.select(self.row_id), signals.select(
            *dict.fromkeys([self.row_id, *wanted])), self.row_id, self.n_rows_bound // max(1, self.n_batches))

    def combine(self, other: Sampling) -> Sampling:
        """Append the batches of ``other``, numbered on from this sampling's last batch."""
        if self.target != other.target:
            raise ValueError("target variables differ")
        if len(self.inputs) != len(other.inputs) or not same_variables(self.inputs, other.inputs):
            raise ValueError("input variables differ")
        if self.row_id != other.row_id:
            raise ValueError("row ids differ")
        moved = other.draws.withColumn("batch", F.col("batch") + self.n_batches)
        return replace(
            self,
            draws=self.draws.unionByName(moved),
            n_batches=self.n_batches + other.n_batches,
            balanced=self.balanced and other.balanced,
            resample=self.resample or other.resample,
            n_rows_bound=self.n_rows_bound + other.n_rows_bound,
        )


def check_samplings(train: Sampling, test: Sampling) -> None:
    """Train and test batches must share target and inputs."""
    if not isinstance(train, Sampling) or not isinstance(test, Sampling):
        raise TypeError("train and test batches must be Sampling objects")
    if train.target != test.target:
        raise ValueError("train and test have different target variables")
    if not same_variables(train.inputs, test.inputs):
        raise ValueError("train and test have different input variables")
    if train.row_id != test.row_id:
        raise ValueError("train and test name their rows by different columns")


def fetch_rows(draws: DataFrame, signals: DataFrame, on, n_draws: int, limit: int = DRAWS_BROADCAST) -> DataFrame:
    """Join drawn ids to their rows.

    The number of draws follows from the settings, so the draws are broadcast when that
    number is within ``limit`` and the signals then stay where they are; else both shuffle.
    """
    side = F.broadcast(draws) if 0 < n_draws <= limit else draws
    return signals.join(side, on)


def binary_class(target: str) -> Column:
    """0 or 1; any other value that is not null stops the job."""
    other = F.raise_error(F.concat(F.lit(f"target {target!r} must be 0 or 1, found "), F.col(target).cast("string"))).cast("int")
    return F.when(F.col(target).isNull() | F.col(target).isin(0, 1), F.col(target).cast("int")).otherwise(other)


def generate_batches(df: DataFrame, n_batches: int, batch_len: int, target: str, row_id: str, inputs=None,
                     balanced: bool = True, resample: bool = True, seed=0, bits: int | None = None) -> Sampling:
    """Draw ``n_batches`` batches of signals.

    Balanced batches hold ``batch_len // 2`` rows of each class. Without ``resample`` a
    batch has no row twice and its size is limited by the rows there are.
    """
    inputs = resolve_variables(df, target, inputs)
    require_columns(df, [row_id])
    if n_batches < 1 or batch_len < 1:
        raise ValueError("n_batches and batch_len must be positive")
    if balanced:
        pool = df.filter(F.col(target).isNotNull()).withColumn("class", binary_class(target))
    else:
        pool = df.withColumn("class", F.lit("all"))
    rows = index_rows(pool, ["class"], row_id)
    found = {c: n for (c,), n in group_sizes(rows, ["class"]).items()}
    if balanced and set(found) != {0, 1}:
        raise ValueError(f"balanced batches need both classes 0 and 1; found {sorted(found)}")
    if not found:
        raise ValueError("no rows to sample from")
    k = batch_len // 2 if balanced else batch_len
    if not resample:
        k = min(k, *found.values())
    draw = draw_with_replacement if resample else draw_without_replacement
    draws = draw(rows, ["class"], [(c, n, k) for c, n in found.items()], row_id, seed, "batch",
                 batches=("batch", n_batches), bits=bits)
    return Sampling(
        draws=draws.select("batch", row_id),
        row_id=row_id,
        target=target,
        inputs=inputs,
        n_batches=n_batches,
        balanced=balanced,
        resample=resample,
        n_rows_bound=n_batches * k * len(found),
    )


def balanced_sample(df: DataFrame, column: str, row_id: str, max_len: int | None = None, seed=0,
                    bits: int | None = None) -> DataFrame:
    """Balanced sample by a two-valued column: ``(row_id, n_draws)``, drawn with replacement."""
    values = require_binary(df, column)
    pool = df.withColumn("class", F.when(F.col(column).eqNullSafe(F.lit(values[0])), 0).otherwise(1))
    rows = index_rows(pool, ["class"], row_id)
    sizes = group_sizes(rows, ["class"])
    k = min(sizes.values()) if max_len is None else min(max_len, *sizes.values())
    groups = [(*g, n, k) for g, n in sizes.items()]
    drawn = draw_with_replacement(rows, ["class"], groups, row_id, seed, "balance", bits=bits)
    return drawn.groupBy(row_id).agg(F.count("*").alias("n_draws"))


def shuffled(df: DataFrame, row_id: str, seed=0) -> DataFrame:
    """Rows in a repeatable random order."""
    return df.orderBy(hash60(seed, "shuffle", F.col(row_id)), row_id)


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a sorted table from 0: rows per partition first, then the place in the partition."""
    rows = pin(ordered.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)  # the upper bits number the partition
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(broadcast_if_small(pin(starts)), part == F.col("__part")).withColumn(name, place).drop("__place", "__part", "__start")
