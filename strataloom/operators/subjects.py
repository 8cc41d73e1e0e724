"""Subject table, class counts and joins of signals to subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.materialize import settle

N_DRAWS = "n_draws"
VARIES = "__varies_"
# Rows of one subject that one task of a shuffled join takes; subjects beyond are spread over more tasks.
TASK_ROWS = 1_000_000
SALTS = "__salts"


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found; available: {df.columns}")


def _maximum(df: DataFrame, column: str) -> Column:
    """Largest value, with NaN treated as missing."""
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.max(F.nanvl(F.col(column), F.lit(None)))
    return F.max(column)


def roll_up_subjects(signals: DataFrame, subject: str, info=None, watched=(), rows: str | None = None) -> DataFrame:
    """One row per subject holding the maximum of each info column.

    Null subjects are dropped. ``max`` combines on the map side, so a subject with a
    large share of the rows costs no more than any other. For ``watched`` columns a flag
    ``__varies_…`` tells whether they vary within the subject; ``rows`` names a row count.
    """
    require_columns(signals, [subject])
    columns = list(dict.fromkeys(c for c in (signals.columns if info is None else info) if c != subject))
    require_columns(signals, [*columns, *watched])
    extra = [(F.min(c) != F.max(c)).alias(f"{VARIES}{c}") for c in watched]
    if rows is not None:
        extra.append(F.count("*").alias(rows))
    known = signals.filter(F.col(subject).isNotNull())
    values = [_maximum(signals, c).alias(c) for c in columns] + extra
    return known.groupBy(subject).agg(*values) if values else known.select(subject).distinct()


def varying_within_subject(signals: DataFrame, subject: str, columns) -> DataFrame:
    """Per column, the number of subjects in which it takes more than one value."""
    per_subject = signals.filter(F.col(subject).isNotNull()).groupBy(subject).agg(
        *[(F.min(c) != F.max(c)).alias(c) for c in columns]
    )
    counted = per_subject.agg(*[F.count_if(F.col(c)).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column", "n_subjects")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def require_binary(df: DataFrame, column: str) -> list:
    """The two distinct values of ``column`` (null counts as one); error otherwise."""
    found = [r[0] for r in distinct_values(df, column).limit(3).collect()]
    if len(found) != 2:
        raise ValueError(f"column {column!r} must have exactly two values, found {found}")
    return sorted(found, key=lambda v: (v is None, v))


def class_counts(df: DataFrame, target: str, by=()) -> DataFrame:
    return df.groupBy(*by, target).agg(F.count("*").alias("n"))


def minority_size(df: DataFrame, target: str, by=()) -> DataFrame:
    """Rows of the smaller class, one row per group."""
    return class_counts(df, target, by).groupBy(*by).agg(F.min("n").alias("n_minority"))


def class_filter(df: DataFrame, target: str, value: int) -> DataFrame:
    return df.filter(F.col(target) == value)


def split_by_value(df: DataFrame, column: str, value, flag: str = "matches") -> DataFrame:
    """Two-way partition: rows equal to ``value`` and all others, nulls among the others."""
    return df.withColumn(flag, F.col(column).eqNullSafe(F.lit(value)))


def subject_sizes(signals: DataFrame, subject: str, rows: str = "n_rows") -> DataFrame:
    """Rows per subject."""
    return signals.filter(F.col(subject).isNotNull()).groupBy(subject).agg(F.count("*").alias(rows))


def hot_subjects(sizes: DataFrame, subject: str, rows: str = "n_rows", task_rows: int = TASK_ROWS) -> DataFrame:
    """Subjects with more than ``task_rows`` rows, and the number of keys over which a join spreads them.

    Their number is at most the number of all rows over ``task_rows``.
    """
    salts = F.ceil(F.col(rows) / task_rows).cast("int").alias(SALTS)
    return settle(sizes.filter(F.col(rows) > task_rows).select(subject, salts))


def join_members(signals: DataFrame, members: DataFrame, subject: str, row_key: str, hot: DataFrame | None = None) -> DataFrame:
    """Signals of the listed subjects, one output row per (signal, member row).

    ``members`` carries ``n_draws`` as a weight instead of repeating signals. Rows of the
    ``hot`` subjects are spread over several join keys; their member rows are repeated
    once per key, so no task receives all rows of one subject.
    """
    if hot is None:
        return signals.join(members, subject)
    salts = F.coalesce(F.col(SALTS), F.lit(1))
    left = signals.join(hot, subject, "left").withColumn("__salt", F.pmod(F.xxhash64(F.col(row_key)), salts).cast("int"))
    right = members.join(hot, subject, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop(SALTS).join(right.drop(SALTS), [subject, "__salt"]).drop("__salt")


def signals_of_members(signals: DataFrame, members: DataFrame, subject: str, row_key: str | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Right join of signals to drawn subjects: a subject without signals yields nulls.

    With ``hot`` subjects, which have signals, only the others go through the right join.
    """
    if hot is None:
        return signals.join(members, subject, "right")
    names = hot.select(subject)
    rest = signals.join(names, subject, "left_anti").join(members.join(names, subject, "left_anti"), subject, "right")
    return rest.unionByName(join_members(signals.join(names, subject, "left_semi"), members.join(names, subject, "left_semi"), subject, row_key, hot))


def expand_draws(df: DataFrame, weight: str = N_DRAWS) -> DataFrame:
    """Repeat each row as often as it was drawn."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int")))).drop(
        "__copy", weight
    )


def without_subjects(subjects: DataFrame, held_out: DataFrame, subject: str) -> DataFrame:
    """Subjects that do not occur in ``held_out``."""
    return subjects.join(held_out.select(subject), subject, "left_anti")
