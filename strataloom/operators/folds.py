"""Subject-level folds: one table ``(fold, role, subject, n_draws)`` for all folds.

Roles are ``fit`` and ``val``; a subject drawn several times carries the number of draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.draws import (
    DRAWS_BROADCAST,
    draw_with_replacement,
    group_sizes,
    index_rows,
    n_draws_of,
    small_table,
)
from strataloom.operators.subjects import N_DRAWS, require_binary, require_columns


def _class_of(target: str, values: list):
    return F.when(F.col(target).eqNullSafe(F.lit(values[0])), 0).otherwise(1)


def holdout_folds(subjects: DataFrame, subject: str, target: str, n_folds: int, test_size: int, seed=0,
                  bits: int | None = None) -> DataFrame:
    """Repeated random hold-out.

    Each fold draws ``min(test_size, minority)`` subjects per class, with replacement, for
    validation; every subject not drawn is in the fit set.
    """
    require_columns(subjects, [subject, target])
    values = require_binary(subjects, target)
    pool = subjects.select(subject, _class_of(target, values).alias("class"))
    rows = index_rows(pool, ["class"], subject)
    sizes = group_sizes(rows, ["class"])
    k = min(test_size, *sizes.values())
    groups = [(*g, n, k) for g, n in sizes.items()]
    drawn = (
        draw_with_replacement(rows, ["class"], groups, subject, seed, "holdout", batches=("fold", n_folds), bits=bits)
        .groupBy("fold", subject)
        .agg(F.count("*").alias("__drawn"))
    )
    if n_draws_of(groups, ("fold", n_folds)) <= DRAWS_BROADCAST:
        drawn = F.broadcast(drawn)
    everyone = subjects.select(subject).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return everyone.join(drawn, ["fold", subject], "left").select(
        "fold",
        F.when(F.col("__drawn").isNull(), "fit").otherwise("val").alias("role"),
        subject,
        F.coalesce("__drawn", F.lit(1)).cast("bigint").alias(N_DRAWS),
    )


def strata_values(subjects: DataFrame, strata: str) -> list:
    """Names of the folds: the distinct non-null strata (one fold is fitted for each)."""
    return sorted(r[0] for r in subjects.select(strata).distinct().collect() if r[0] is not None)


def strata_folds(subjects: DataFrame, subject: str, strata: str, balanced_by: str | None = None, values=None,
                 seed=0, bits: int | None = None) -> DataFrame:
    """One fold per stratum: its subjects validate, all others fit.

    With ``balanced_by`` each side that has exactly two values of that column is replaced by
    a balanced sample with replacement; a side with one value is kept as it is.
    """
    require_columns(subjects, [subject, strata, *([balanced_by] if balanced_by else [])])
    known = strata_values(subjects, strata)
    if values is not None:
        absent = [v for v in values if v not in known]
        if absent:
            raise ValueError(f"strata {absent} not present in column {strata!r}")
        known = list(values)
    columns = dict.fromkeys([subject, strata, *([balanced_by] if balanced_by else [])])
    sides = subjects.select(*columns).withColumn(
        "fold", F.explode(F.array(*[F.lit(v) for v in known]))
    ).withColumn("role", F.when(F.col(strata).eqNullSafe(F.col("fold")), "val").otherwise("fit"))
    if balanced_by is None:
        return sides.select("fold", "role", subject, F.lit(1).cast("bigint").alias(N_DRAWS))

    side = ["fold", "role"]
    sides = sides.withColumn("class", F.coalesce(F.col(balanced_by).cast("string"), F.lit("null")))
    by = [*side, "class"]
    rows = index_rows(sides, by, subject)
    found: dict[tuple, dict] = {}
    for (fold, role, value), n in group_sizes(rows, by).items():
        found.setdefault((fold, role), {})[value] = n
    balanced = {s: c for s, c in found.items() if len(c) == 2}
    kept_whole = [s for s in found if s not in balanced]
    groups = [(*s, v, n, min(c.values())) for s, c in balanced.items() for v, n in c.items()]
    drawn = None
    if groups:
        drawn = (
            draw_with_replacement(rows, by, groups, subject, seed, "balance", bits=bits)
            .groupBy(*side, subject)
            .agg(F.count("*").alias(N_DRAWS))
        )
    if not kept_whole:
        return drawn
    fields = [("fold", subjects.schema[strata].dataType.simpleString()), ("role", "string")]
    untouched = small_table(subjects.sparkSession, kept_whole, fields)
    whole = (
        sides.join(F.broadcast(untouched), side, "left_semi")
        .select(*side, subject, F.lit(1).cast("bigint").alias(N_DRAWS))
    )
    return whole if drawn is None else drawn.unionByName(whole)
