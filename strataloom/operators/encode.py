"""Category encoders, fitted per key on fit rows and applied to any rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.materialize import settle
from strataloom.operators.cells import WEIGHT, FitCells
from strataloom.operators.keyed import Keyed
from strataloom.operators.settings import only_default
from strataloom.operators.subjects import require_columns

# Every category becomes a column; their counts per fold are held on the driver.
MAX_CATEGORIES = 100_000


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _categories(df: DataFrame, columns) -> Column:
    """One (column, value) row per encoded column; a single pass serves all columns."""
    return F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )


class OneHotEncoder:
    """Replaces each column by 0/1 columns ``col_1 … col_n``, one per category.

    Categories are those seen in the fit rows of any key, ordered by value with null last.
    A category not seen in the fit rows of a row's key gives zeros. ``drop_invariant``
    drops outputs that are constant on the fit rows of every key.
    """

    def __init__(self, columns, drop_invariant: bool = False, **other):
        only_default("one_hot", other, {"handle_unknown": "value", "handle_missing": "value", "use_cat_names": False, "return_df": True})
        self.columns = list(columns)
        self.drop_invariant = drop_invariant

    def fit(self, df: DataFrame, keys=(), weight: str | None = None, target: str | None = None,
            cells: FitCells | None = None) -> OneHotModel:
        keyed = Keyed(keys)
        df, by = keyed.source(df, cells)
        require_columns(df, self.columns)
        counted = df.select(*by, _categories(df, self.columns).alias("__c")).groupBy(
            *by, "__c.column", "__c.value"
        ).agg(F.count("*").alias("n"))
        if cells is not None:
            counted = cells.merge(counted).groupBy(*keyed.keys, "column", "value").agg(F.sum("n").alias("n"))
        counted = counted.limit(MAX_CATEGORIES + 1).collect()
        if len(counted) > MAX_CATEGORIES:
            raise ValueError(f"one_hot: over {MAX_CATEGORIES} categories of all folds; encode by target instead")
        counts: dict[tuple, dict[tuple, int]] = {}
        for r in counted:
            counts.setdefault(tuple(r[k] for k in keyed.keys), {})[(r["column"], r["value"])] = r["n"]
        rows_of = {k: sum(n for (c, _), n in seen.items() if c == self.columns[0]) for k, seen in counts.items()}
        outputs = []
        for c in self.columns:
            numeric = isinstance(df.schema[c].dataType, T.NumericType)
            values = {v for seen in counts.values() for (name, v) in seen if name == c}
            ordered = sorted(values, key=lambda v: (v is None, 0 if v is None else float(v) if numeric else v))
            for i, v in enumerate(ordered, start=1):
                constant = all(seen.get((c, v), 0) in (0, rows_of[k]) for k, seen in counts.items())
                if not (self.drop_invariant and constant):
                    outputs.append((c, v, f"{c}_{i}"))
        positions = [
            (*key, c, _label(v), j) for key, seen in counts.items() for j, (c, v, _) in enumerate(outputs) if (c, v) in seen
        ]
        fields = [f"`{k}` {df.schema[k].dataType.simpleString() if cells is None else cells.weights.schema[k].dataType.simpleString()}" for k in keyed.keys]
        codes = df.sparkSession.createDataFrame(positions, ", ".join([*fields, "column string", "__value string", "__at int"]))
        return OneHotModel(self.columns, outputs, keyed, codes)


def _label(value: str | None) -> str:
    """A category as text that tells null from every value."""
    return "null" if value is None else f"={value}"


class OneHotModel:
    """``codes`` holds the output number of every category that the fit rows of a key showed."""

    def __init__(self, columns, outputs, keyed, codes):
        self.columns, self.outputs, self.keyed, self.codes = columns, outputs, keyed, codes
        self.added = [name for _, _, name in outputs]
        self.dropped = list(columns)

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in self.columns]
        df = self.keyed.add(df)
        found = {}
        for i, c in enumerate(dict.fromkeys(self.columns)):
            # at most MAX_CATEGORIES rows for all columns and keys
            codes = self.codes.where(F.col("column") == c).drop("column").withColumnRenamed("__at", f"__at{i}")
            value = F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
            df = df.withColumn("__value", value).join(F.broadcast(codes), [*self.keyed.keys, "__value"], "left").drop("__value")
            found[c] = F.col(f"__at{i}")
        codes = [F.coalesce(found[column] == j, F.lit(False)).cast("int").alias(name) for j, (column, _, name) in enumerate(self.outputs)]
        return df.select(*kept, *codes)


class TargetEncoder:
    """Replaces each category by its smoothed target mean.

    ``prior * (1 - s) + mean * s`` with ``s = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))``
    over the fit rows of the key; unseen and null categories get the prior.
    """

    def __init__(self, columns, min_samples_leaf: float = 20, smoothing: float = 10.0, **other):
        only_default("target_encoder", other, {"handle_unknown": "value", "handle_missing": "value", "drop_invariant": False, "return_df": True})
        self.columns = list(columns)
        self.min_samples_leaf = min_samples_leaf
        self.smoothing = smoothing

    def fit(self, df: DataFrame, keys=(), weight: str | None = None, target: str | None = None,
            cells: FitCells | None = None) -> TargetModel:
        if target is None:
            raise ValueError("target encoding needs a target column")
        keyed = Keyed(keys)
        df, by = keyed.source(df, cells)
        require_columns(df, [*self.columns, target])
        w, y = _weight(None if cells else weight), F.col(target).cast("double")
        rows = df.select(*by, w.alias("__w"), (w * y).alias("__wy"), _categories(df, self.columns).alias("__c"))
        # one pass: the first column's categories (null included) add up to the prior
        stats = rows.groupBy(*by, "__c.column", "__c.value").agg(F.sum("__w").alias("n"), F.sum("__wy").alias("s"))
        if cells is not None:
            times = F.col(WEIGHT)
            stats = cells.merge(stats).groupBy(*keyed.keys, "column", "value").agg(
                F.sum(times * F.col("n")).alias("n"), F.sum(times * F.col("s")).alias("s")
            )
        stats = settle(stats)
        prior = stats.filter(F.col("column") == self.columns[0]).groupBy(*keyed.keys).agg(
            (F.sum("s") / F.sum("n")).alias("__prior")
        )
        prior = settle(prior)
        share = 1 / (1 + F.exp(-(F.col("n") - self.min_samples_leaf) / F.lit(float(self.smoothing))))
        codes = (
            stats.filter(F.col("value").isNotNull())
            .join(prior, keyed.keys)
            .select(*keyed.keys, "column", "value",
                    (F.col("__prior") * (1 - share) + F.col("s") / F.col("n") * share).alias("__code"))
        )
        return TargetModel(self.columns, settle(codes), prior, keyed)


class TargetModel:
    added: list = []
    dropped: list = []

    def __init__(self, columns, codes, prior, keyed):
        self.columns, self.codes, self.prior, self.keyed = columns, codes, prior, keyed

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        df = self.keyed.add(df).join(self.prior, self.keyed.keys)
        for c in self.columns:
            codes = self.codes.filter(F.col("column") == c).select(
                *self.keyed.keys, F.col("value").alias("__value"), "__code"
            )
            df = (
                df.withColumn("__value", F.col(c).cast("string"))
                .join(codes, [*self.keyed.keys, "__value"], "left")
                .withColumn(c, F.coalesce("__code", "__prior"))
                .drop("__value", "__code")
            )
        return df.select(*order)
