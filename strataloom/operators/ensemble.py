"""Voting ensembles of mixed weak learners, fitted for all folds together."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.hashing import hash60, uniform
from strataloom.materialize import broadcast_if_small, pin, settle
from strataloom.operators import newton, trees
from strataloom.operators.draws import (
    DRAWS_BROADCAST,
    ORDER,
    draw_with_replacement,
    drawn_positions,
    group_sizes,
    holders_at_positions,
    index_rows,
    n_draws_of,
    prefix_bits,
    rows_at_positions,
    small_table,
)
from strataloom.operators.knn import batch_votes, knn_votes, nearest
from strataloom.operators.metrics import check_threshold, classify
from strataloom.operators.ridge import linear_vote, ridge_grams, score_linear, solve_ridge
from strataloom.operators.sampling import Sampling, binary_class, check_samplings, fetch_rows, resolve_variables
from strataloom.operators.settings import only_default, reject_unknown
from strataloom.operators.subjects import N_DRAWS, require_binary, require_columns

KINDS = ("Ridge", "knn", "logistic", "SVM", "tree", "rf")
# Settings each learner understands; solver settings that do not change an exact solution are accepted.
SETTINGS = {
    "Ridge": ("alpha", "fit_intercept", "copy_X", "solver", "tol", "max_iter", "random_state"),
    "knn": ("n_neighbors",),
    "logistic": ("C", "fit_intercept", "max_iter"),
    "SVM": ("C", "fit_intercept", "max_iter"),
    "tree": ("max_depth", "max_features", "min_samples_leaf", "min_samples_split", "random_state"),
    "rf": ("n_estimators", "bootstrap", "max_depth", "max_features", "min_samples_leaf", "min_samples_split", "random_state"),
}
# Settings whose only supported value is the usual default.
DEFAULTS = {
    "knn": {"weights": "uniform", "p": 2, "metric": "minkowski"}, "tree": {"criterion": "gini", "splitter": "best"}, "rf": {"criterion": "gini"},
    "SVM": {"kernel": "linear"}, "logistic": {"penalty": "l2"},
}
ATTEMPTS_PER_NODE = 20
# Model numbers shipped to the tasks in one piece; folds beyond it are predicted in turn.
_SHIPPED_NUMBERS = 20_000_000
# Batches up to this length are kept in one task each while their nodes are fitted.
_COLOCATED_ROWS = 1_000_000
_NODE_FIELDS = (
    ("attempt", "bigint"), ("train_batch", "bigint"), ("test_batch", "bigint"), ("params", "map<string,string>"),
    ("intercept", "double"), ("coef", "array<double>"), ("tree", trees.TREE_TYPE), ("test_score", "double"), ("train_score", "double"),
)


@dataclass(frozen=True)
class NodeSpec:
    """``size`` nodes of one learner; a parameter may be a range, drawn anew per attempt."""

    kind: str
    size: int
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown learner {self.kind!r}; valid: {sorted(KINDS)}")
        if self.size < 1:
            raise ValueError("node sizes must be positive")
        known = SETTINGS[self.kind]
        fixed = DEFAULTS.get(self.kind, {})
        reject_unknown(self.kind, self.params, [*known, *fixed])
        only_default(self.kind, {n: v for n, v in self.params.items() if n in fixed}, fixed)


def parameter_range(value):
    """``(low, high)`` of a random parameter, None for a fixed one."""
    if isinstance(value, dict) and set(value) == {"range"}:
        value = tuple(value["range"])
    return value if isinstance(value, tuple) and len(value) == 2 else None


def parameter_column(name: str, value, *key) -> Column:
    """Fixed value, or a draw from ``[low, high)``: whole numbers when ``low`` is one."""
    span = parameter_range(value)
    if span is None:
        return F.lit(value)
    low, high = span
    if isinstance(low, int):
        return F.lit(low) + hash60(*key, name) % F.lit(high - low).cast("bigint")
    return F.lit(float(low)) + uniform(*key, name) * F.lit(float(high) - float(low))


def attempt_table(folds: DataFrame, spec: NodeSpec, kind_no: int, first: int, last: int, seed) -> DataFrame:
    """Attempts ``first … last-1`` of every fold: drawn batch pair and parameters.

    ``folds`` holds ``fold, n_train, n_test`` (numbers of batches).
    """
    table = folds.withColumn("attempt", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last - 1).cast("bigint"))))
    key = (seed, "attempt", kind_no, F.col("fold"), F.col("attempt"))
    values = {n: parameter_column(n, v, *key) for n, v in spec.params.items()}
    pairs = [c for n, v in values.items() for c in (F.lit(n), v.cast("string"))]
    return table.select(
        "fold", "attempt",
        (hash60(*key, "train") % F.col("n_train")).alias("train_batch"),
        (hash60(*key, "test") % F.col("n_test")).alias("test_batch"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("params"),
    )


def accept(scored: DataFrame, cap: float, size: int, by=("fold",)) -> DataFrame:
    """The first ``size`` attempts, by number, whose test score reaches ``cap``."""
    in_order = Window.partitionBy(*by).orderBy("attempt")
    return (
        scored.filter(F.col("test_score") >= cap)
        .withColumn("__n", F.row_number().over(in_order))
        .filter(F.col("__n") <= size)
        .drop("__n")
    )


def number_nodes(nodes: DataFrame, by=("fold",)) -> DataFrame:
    """Number the nodes of a fold by kind and attempt, from 1."""
    return nodes.withColumn("node", F.row_number().over(Window.partitionBy(*by).orderBy("kind_no", "attempt")))


def keep_best(nodes: DataFrame, k: int, by=("fold",)) -> DataFrame:
    """The ``k`` nodes with the best test score; ties by train score, then node number."""
    best = Window.partitionBy(*by).orderBy(F.desc("test_score"), F.desc("train_score"), "node")
    return nodes.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= k).drop("__rank")


@dataclass(frozen=True)
class BatchPlan:
    """Numbers and sizes of the batches; None takes the default of the fold."""

    split_fraction: float = 0.8
    n_train: int | None = None
    n_test: int | None = None
    train_size: int | None = None
    test_size: int | None = None


def present(column: str) -> Column:
    """The column as a number; null and NaN stop a fit."""
    missing = F.raise_error(F.lit(f"feature {column!r} has missing values; fill or drop them before the fit")).cast("double")
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), missing)


def inner_split(fit_members: DataFrame, classes: DataFrame, subject: str, fraction: float, seed,
                bits: int | None = None) -> tuple[DataFrame, dict]:
    """Split each fold's fit subjects into train and test subjects.

    Per class ``ceil((1 - fraction) * subjects)`` subjects (at most the minority) are drawn
    with replacement for testing, the rest train. Returns ``(fold, subject, side, n_draws)``
    and the number of subjects per fold.
    """
    pool = fit_members.join(classes, subject)
    rows = index_rows(pool, ["fold", "class"], subject)
    sizes: dict = {}
    for (fold, c), n in group_sizes(rows, ["fold", "class"]).items():
        sizes.setdefault(fold, {})[c] = n
    groups = []
    for fold, counts in sizes.items():
        if len(counts) != 2:
            raise ValueError(f"fold {fold!r}: fit subjects have classes {sorted(counts)}, two are needed")
        k = min(math.ceil((1.0 - fraction) * sum(counts.values())), *counts.values())
        groups += [(fold, c, n, k) for c, n in counts.items()]
    drawn = (
        draw_with_replacement(rows, ["fold", "class"], groups, subject, seed, "inner", bits=bits)
        .groupBy("fold", subject)
        .agg(F.count("*").alias("__drawn"))
    )
    if n_draws_of(groups) <= DRAWS_BROADCAST:
        drawn = F.broadcast(drawn)
    split = fit_members.join(drawn, ["fold", subject], "left").select(
        "fold", subject,
        F.when(F.col("__drawn").isNull(), "train").otherwise("test").alias("side"),
        (F.col(N_DRAWS) * F.coalesce("__drawn", F.lit(1))).cast("bigint").alias(N_DRAWS),
        F.col(N_DRAWS).alias("__outer"),
    )
    return split, {fold: sum(c.values()) for fold, c in sizes.items()}


def draw_batches(signals: DataFrame, split: DataFrame, n_subjects: dict, plan: BatchPlan, subject: str, target: str,
                 row_id: str, seed, bits: int | None = None) -> tuple[DataFrame, dict, int, int]:
    """Balanced batches of train and test signals for every fold.

    Every draw takes two steps: a position among the signals of (fold, side, class), which stand in the order of their
    subjects, falls on a subject by running sums over the subjects; the place within the subject then falls on a signal
    by a rank that is the same for all folds. The signals are read once to count and once to rank, however many folds there are.

    Returns draws ``(fold, side, batch, slot, row_id)``, ``fold -> (n_train, n_test)``, the
    number of draws and the largest batch.
    """
    known = signals.filter(F.col(target).isNotNull()).select(row_id, subject, binary_class(target).alias("class"))
    by = ["fold", "side", "class"]
    counted = pin(known.groupBy(subject, "class").agg(F.count("*").alias("__rows")))
    times = (F.col("__rows") * F.col(N_DRAWS)).alias("__times")
    members = counted.join(split, subject).select(
        *by, subject, times, F.col(N_DRAWS).alias("__w"), "__rows", "__outer", hash60(F.col(subject)).alias(ORDER))
    totals = members.groupBy(*by).agg(
        F.sum("__times").alias("n"), F.sum(F.col("__rows") * F.col("__outer")).alias("outer"), F.count("*").alias("members"), F.max("__rows").alias("longest")
    ).collect()
    sizes = {(r["fold"], r["side"], r["class"]): r["n"] for r in totals}
    # default batch sizes follow the fold's fit rows, before the inner draws
    n_rows: dict = {}
    for r in totals:
        n_rows[r["fold"]] = n_rows.get(r["fold"], 0) + r["outer"]
    groups, counts, batches = [], [], {}
    for fold, n in n_subjects.items():
        n_train = plan.n_train or n
        n_test = plan.n_test or n_train
        train = plan.train_size or int(plan.split_fraction * n_rows[fold])
        test = plan.test_size or int((1.0 - plan.split_fraction) * n_rows[fold])
        batches[fold] = (n_train, n_test)
        for side, count, size in (("train", n_train, train), ("test", n_test, test)):
            for c in (0, 1):
                if (fold, side, c) not in sizes:
                    raise ValueError(f"fold {fold!r}: no {side} signals of class {c}")
                groups.append((fold, side, c, sizes[(fold, side, c)], size // 2))
                counts.append(count)
    n_draws = n_draws_of(groups, ("", counts))
    widths = [(r["fold"], r["side"], r["class"], max(1, r["n"] // r["members"])) for r in totals]
    drawn = drawn_positions(members, by, groups, seed, "batch", ("batch", counts)).drop("n")
    most = prefix_bits(max(r["members"] for r in totals)) if bits is None else bits
    held = holders_at_positions(drawn, members, by, subject, most, widths, n_draws).select(
        "fold", "side", "class", "batch", "slot", subject, F.expr("offset div __w").alias("position"), F.col("__rows").alias("n"))
    longest = prefix_bits(max(r["longest"] for r in totals)) if bits is None else bits
    found = rows_at_positions(held, index_rows(known, [subject, "class"], row_id), [subject, "class"], row_id, longest, n_draws)
    slot = F.when(F.col("class") == 1, F.col("slot") * 2 + 1).otherwise(F.col("slot") * 2)
    return found.select("fold", "side", "batch", slot.alias("slot"), row_id), batches, n_draws, 2 * max(g[-1] for g in groups)


class Ensemble:
    """Learner kinds with node counts and settings."""

    def __init__(self, classifier_list, node_sizes, kwargs_list=None, attempts_per_node: int = ATTEMPTS_PER_NODE):
        kwargs_list = kwargs_list or [{}] * len(classifier_list)
        if not len(classifier_list) == len(node_sizes) == len(kwargs_list):
            raise ValueError("one node count and one settings map per learner")
        self.specs = [NodeSpec(k, n, dict(p)) for k, n, p in zip(classifier_list, node_sizes, kwargs_list)]
        self.attempts_per_node = attempts_per_node

    def fit(self, signals: DataFrame, target: str, subjects: DataFrame, subject: str, row_id: str,
            fit_variables=None, plan: BatchPlan = BatchPlan(), score_cap: float = 0.5, get_best: int | None = None,
            seed=0) -> FittedEnsemble:
        """Fit one ensemble on all signals of ``subjects``."""
        features = [v for v in resolve_variables(signals, target, fit_variables) if v not in (row_id, subject)]
        members = subjects.select(subject, F.lit(0).alias("fold"), F.lit(1).cast("bigint").alias(N_DRAWS))
        return self.fit_folds(signals, members, subjects.select(subject, target), subject, target, row_id,
                              lambda df: df, features, plan, score_cap, get_best, seed)

    def fit_folds(self, signals: DataFrame, fit_members: DataFrame, subject_classes: DataFrame, subject: str,
                  target: str, row_id: str, transform: Callable[[DataFrame], DataFrame], features,
                  plan: BatchPlan = BatchPlan(), score_cap: float = 0.5, get_best: int | None = None, seed=0) -> FittedEnsemble:
        """Fit one ensemble per fold of ``fit_members`` ``(fold, subject, n_draws)``.

        Only drawn rows are transformed: ``transform`` receives raw rows with their ``fold``.
        """
        require_columns(signals, [row_id, subject, target])
        values = require_binary(subject_classes, target)
        classes = subject_classes.select(
            subject, F.when(F.col(target).eqNullSafe(F.lit(values[0])), 0).otherwise(1).alias("class")
        )
        split, n_subjects = inner_split(fit_members, classes, subject, plan.split_fraction, seed)
        draws, batches, n_draws, batch_len = draw_batches(
            signals, broadcast_if_small(pin(split)), n_subjects, plan, subject, target, row_id, seed
        )
        drawn = fetch_rows(draws, signals, row_id, n_draws)
        rows = transform(drawn.withColumn("__truth", F.col(target).cast("int"))).select(
            "fold", "side", "batch", "slot", F.col("__truth").alias("y"),
            *[present(c).alias(c) for c in features],
        )
        return self._fit_rows(rows, batches, batch_len, features, target, row_id, score_cap, get_best, seed)

    def fit_samplings(self, signals: DataFrame, train: Sampling, test: Sampling, score_cap: float = 0.5, get_best: int | None = None,
                      seed=0) -> FittedEnsemble:
        """Fit one ensemble on batches drawn before; both samplings must share target, inputs and row ids."""
        check_samplings(train, test)
        features = list(train.inputs)
        require_columns(signals, [train.row_id, train.target, *features])
        # equal rows of a batch are interchangeable, so their order within the batch decides nothing
        place = (F.row_number().over(Window.partitionBy("side", "batch").orderBy(train.row_id)) - 1).cast("bigint")
        draws = [s.draws.select(F.lit(side).alias("side"), "batch", train.row_id) for side, s in (("train", train), ("test", test))]
        drawn = fetch_rows(draws[0].unionByName(draws[1]), signals, train.row_id, train.n_rows_bound + test.n_rows_bound)
        rows = drawn.withColumn("slot", place).select(
            F.lit(0).alias("fold"), "side", "batch", "slot", binary_class(train.target).alias("y"), *[present(c).alias(c) for c in features])
        longest = max(s.n_rows_bound // s.n_batches for s in (train, test))
        return self._fit_rows(rows, {0: (train.n_batches, test.n_batches)}, longest, features, train.target, train.row_id, score_cap, get_best, seed)

    def _fit_rows(self, rows: DataFrame, batches: dict, batch_len: int, features, target: str, row_id: str, score_cap: float, get_best: int | None, seed) -> FittedEnsemble:
        """Nodes of all kinds on the rows ``fold, side, batch, slot, y, features…`` of the batches."""
        # a batch in one partition needs no merging of partial sums
        rows = pin(rows.repartition("fold", "side", "batch") if batch_len <= _COLOCATED_ROWS else rows)
        kind = dict(rows.dtypes)["fold"]
        folds = small_table(
            rows.sparkSession, [(f, a, b) for f, (a, b) in batches.items()],
            [("fold", kind), ("n_train", "bigint"), ("n_test", "bigint")],
        )
        context = _Fit(rows, folds, list(batches), kind, list(features), batch_len, score_cap, seed,
                       self.attempts_per_node)
        parts = [context.fit_kind(spec, n) for n, spec in enumerate(self.specs)]
        nodes = parts[0]
        for part in parts[1:]:
            nodes = nodes.unionByName(part)
        nodes = number_nodes(nodes)
        n_nodes = sum(s.size for s in self.specs)
        if get_best is not None:
            nodes, n_nodes = keep_best(nodes, get_best), min(get_best, n_nodes)
        return FittedEnsemble(settle(nodes), n_nodes, list(features), target, row_id, rows, batch_len, self.specs)


@dataclass
class _Fit:
    rows: DataFrame
    folds: DataFrame
    fold_values: list
    fold_type: str
    features: list
    batch_len: int
    cap: float
    seed: object
    per_node: int

    def fit_kind(self, spec: NodeSpec, kind_no: int) -> DataFrame:
        """Waves of attempts until every fold has its nodes; the accepted set does not depend on waves."""
        run = {"Ridge": self._ridge, "knn": self._knn, "tree": self._trees, "rf": self._trees}.get(spec.kind, self._newton)
        scored, first, limit, open_folds = None, 0, self.per_node * spec.size, self.folds
        wave = spec.size
        while True:
            last = min(limit, first + wave)
            part = run(spec, kind_no, attempt_table(open_folds, spec, kind_no, first, last, self.seed))
            scored = part if scored is None else scored.unionByName(part)
            taken = accept(scored, self.cap, spec.size)
            got = {r["fold"]: r["count"] for r in taken.groupBy("fold").count().collect()}
            missing = [f for f in self.fold_values if got.get(f, 0) < spec.size]
            if not missing:
                break
            if last >= limit:
                best = scored.agg(F.max("test_score")).first()[0]
                raise RuntimeError(
                    f"learner {spec.kind!r}: fewer than {spec.size} nodes reached score {self.cap} "
                    f"in {limit} attempts (best score {best})"
                )
            # folds that have their nodes take no part in later waves
            open_folds = self.folds.join(F.broadcast(small_table(self.folds.sparkSession, [(f,) for f in missing], [("fold", self.fold_type)])), "fold")
            first, wave = last, wave * 2
        return taken.withColumn("kind", F.lit(spec.kind)).withColumn("kind_no", F.lit(kind_no))

    def side(self, side: str) -> DataFrame:
        return self.rows.filter(F.col("side") == side)

    def _columns(self, nodes: DataFrame) -> DataFrame:
        """Node columns in their order; those a learner does not have are null."""
        return nodes.select(
            "fold", *[F.col(n) if n in nodes.columns else F.lit(None).cast(t).alias(n) for n, t in _NODE_FIELDS]
        )

    def _trees(self, spec: NodeSpec, kind_no: int, table: DataFrame) -> DataFrame:
        forest = spec.kind == "rf"
        sizes = self.side("train").groupBy("fold", F.col("batch").alias("train_batch")).agg(F.count(F.lit(1)).alias("rows"))
        drawn = hash60(self.seed, "tree", kind_no, F.col("fold"), F.col("attempt"))
        tries = settle(table.join(sizes, ["fold", "train_batch"]).select(
            "fold", "attempt", "train_batch", "test_batch", F.coalesce(setting("random_state").cast("bigint"), drawn).alias("seed"),
            setting("max_depth").cast("int").alias("max_depth"),
            trees.split_features(F.coalesce(setting("max_features"), F.lit("sqrt" if forest else "all")), len(self.features)).alias("n_features"),
            trees.row_number_setting(F.coalesce(setting("min_samples_leaf"), F.lit("1")), F.col("rows")).alias("min_leaf"),
            trees.row_number_setting(F.coalesce(setting("min_samples_split"), F.lit("2")), F.col("rows")).alias("min_split"),
            F.coalesce(setting("n_estimators").cast("int"), F.lit(100 if forest else 1)).alias("n_trees"),
            F.coalesce(setting("bootstrap").cast("boolean"), F.lit(forest)).alias("bootstrap"),
        ))
        sides = [F.struct(F.lit(s).alias("side"), F.col(f"{s}_batch").alias("batch")) for s in ("train", "test")]
        dealt = tries.select("fold", "attempt", "seed", "n_trees", "bootstrap", F.inline(F.array(*sides)))
        rows = self.rows.join(broadcast_if_small(dealt), ["fold", "side", "batch"])
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("n_trees") - 1)))
        bag = F.when(F.col("bootstrap"), trees.poisson_weight(F.col("seed"), "bag", F.col("tree"), F.col("slot"))).otherwise(1)
        rows = rows.select(
            "fold", "attempt", "tree", "side", "slot", "y", F.when(F.col("side") == "train", bag).otherwise(0).cast("long").alias("w"),
            F.array(*[F.col(c).cast("double") for c in self.features]).alias("x"),
        )
        nodes, moved = trees.grow(rows, tries.drop("train_batch", "test_batch", "n_trees", "bootstrap"), len(self.features))
        grown = trees.as_arrays(nodes).join(trees.scores(nodes, moved), ["fold", "attempt"])
        return settle(self._columns(table.join(grown, ["fold", "attempt"])))

    def _newton(self, spec: NodeSpec, kind_no: int, table: DataFrame) -> DataFrame:
        tries = table.select(
            "fold", "attempt", F.col("train_batch").alias("batch"), F.coalesce(setting("C").cast("double"), F.lit(1.0)).alias("c"),
            F.coalesce(setting("fit_intercept").cast("boolean"), F.lit(True)).alias("fit_intercept"),
            F.coalesce(setting("max_iter").cast("int"), F.lit(newton.MAX_ROUNDS)).alias("max_iter"),
        )
        fitted = newton.fit_linear(spec.kind, self.side("train"), tries, self.features, "y", self.fold_type)
        return self._scored_linear(settle(table.join(fitted, ["fold", "attempt"])))

    def _ridge(self, spec: NodeSpec, kind_no: int, table: DataFrame) -> DataFrame:
        alpha = F.coalesce(setting("alpha").cast("double"), F.lit(1.0))
        free = F.coalesce(setting("fit_intercept").cast("boolean"), F.lit(True))
        tries = table.withColumn("alpha", alpha).withColumn("fit_intercept", free).withColumnRenamed("train_batch", "batch")
        needed = self.side("train").join(F.broadcast(tries.select("fold", "batch").distinct()), ["fold", "batch"], "left_semi")
        grams = ridge_grams(needed, ["fold", "batch"], self.features, "y")
        nodes = settle(
            solve_ridge(grams, tries, ["fold", "batch"], len(self.features))
            .withColumnRenamed("batch", "train_batch").drop("alpha", "fit_intercept")
        )
        return self._scored_linear(nodes)

    def _scored_linear(self, nodes: DataFrame) -> DataFrame:
        for side in ("test", "train"):
            score = score_linear(
                nodes.withColumn("__batch", F.col(f"{side}_batch")), self.side(side),
                {"fold": "fold", "__batch": "batch"}, self.features, "y", f"{side}_score",
            )
            nodes = nodes.join(score, ["fold", "attempt"])
        return settle(self._columns(nodes))

    def _knn(self, spec: NodeSpec, kind_no: int, table: DataFrame) -> DataFrame:
        k = most_neighbours(spec)
        nodes = settle(table.withColumn("k", neighbours()))
        ks = F.broadcast(nodes.select("fold", "attempt", "k"))
        train = self.side("train").join(
            F.broadcast(nodes.select("fold", "attempt", F.col("train_batch").alias("batch"))), ["fold", "batch"]
        )
        for side in ("test", "train"):
            queries = self.side(side).join(
                F.broadcast(nodes.select("fold", "attempt", F.col(f"{side}_batch").alias("batch"))), ["fold", "batch"]
            )
            found = _knn_on_slots(queries, train, self.features, k, self.batch_len, ks)
            truth = queries.select("fold", "attempt", F.col("slot").alias("query_slot"), "y")
            score = (
                found.join(truth, ["fold", "attempt", "query_slot"])
                .groupBy("fold", "attempt")
                .agg(F.avg((F.col("vote") == F.col("y")).cast("double")).alias(f"{side}_score"))
            )
            nodes = nodes.join(score, ["fold", "attempt"])
        return settle(self._columns(nodes.drop("k")))


def setting(name: str) -> Column:
    """A setting of an attempt, as text; null if it was not given."""
    return F.try_element_at("params", F.lit(name))


def neighbours() -> Column:
    """Number of neighbours of an attempt."""
    return F.coalesce(setting("n_neighbors").cast("int"), F.lit(5))


def most_neighbours(spec: NodeSpec) -> int:
    """The largest number of neighbours that an attempt can draw."""
    value = spec.params.get("n_neighbors", 5)
    span = parameter_range(value)
    return max(int(span[0]), int(span[1]) - 1) if span else int(value)


def nearest_of_each(found: DataFrame, ks: DataFrame, query_id: str, train_id: str) -> DataFrame:
    """Of the nearest rows of each query, as many as the attempt drew (``ks``: ``fold, attempt, k``)."""
    order = Window.partitionBy("fold", "attempt", query_id).orderBy("distance2", train_id)
    ranked = found.withColumn("__rank", F.row_number().over(order)).join(ks, ["fold", "attempt"])
    return ranked.filter(F.col("__rank") <= F.col("k")).drop("__rank", "k")


def _knn_on_slots(queries: DataFrame, train: DataFrame, features, k: int, n_rows: int, ks: DataFrame) -> DataFrame:
    found = nearest(
        queries.withColumnRenamed("slot", "query_slot"), train, ["fold", "attempt"], features, "y",
        "query_slot", "slot", k, n_rows, n_rows,
    )
    return knn_votes(nearest_of_each(found, ks, "query_slot", "slot"), ["fold", "attempt"], "query_slot")


@dataclass
class FittedEnsemble:
    """Nodes per fold, ready to vote."""

    nodes: DataFrame
    n_nodes: int
    features: list
    target: str
    row_id: str
    batch_rows: DataFrame
    batch_len: int
    specs: list

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """Adds ``proba``, the share of the fold's nodes that vote 1; null if a feature is null or NaN.

        A frame without a ``fold`` column is predicted by the only fold, 0.
        """
        require_columns(rows, [self.row_id, *self.features])
        single = "fold" not in rows.columns
        df = rows.withColumn("fold", F.lit(0)) if single else rows
        kept = df.columns
        kinds = {r["kind"] for r in self.nodes.select("kind").distinct().collect()}
        steps = [("__shipped", bool(kinds - {"knn"}), self._shipped), ("__near", "knn" in kinds, self._knn)]
        votes = []
        for name, used, step in steps:
            if used:
                df = step(df).withColumnRenamed("__votes", name)
                votes.append(name)
        total = F.lit(0.0)
        for v in votes:
            total = total + F.coalesce(F.col(v), F.lit(0.0))
        whole = F.lit(True)
        for c in self.features:
            value = F.col(c).cast("double")
            whole = whole & value.isNotNull() & ~F.isnan(value)
        out = df.select(*kept, F.when(whole, total / float(self.n_nodes)).alias("proba"))
        return out.drop("fold") if single else out

    def predict(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds ``proba`` and the class ``pred``."""
        check_threshold(threshold)
        return classify(self.predict_proba(rows), threshold)

    def _shipped(self, df: DataFrame) -> DataFrame:
        """Votes of linear nodes and trees, by one vectorised function over all folds.

        Models are sent to the tasks fold by fold in pieces of bounded size; usually one.
        """
        found = self.nodes.filter(F.col("coef").isNotNull() | F.col("tree").isNotNull()).select(
            "fold", "intercept", "coef", "tree"
        )
        linear, grown, size = {}, {}, {}
        for r in found.toLocalIterator():
            if r["coef"] is not None:
                linear.setdefault(r["fold"], []).append([r["intercept"], *r["coef"]])
                size[r["fold"]] = size.get(r["fold"], 0) + len(r["coef"]) + 1
            else:
                grown.setdefault(r["fold"], []).append([trees.tree_arrays(t) for t in r["tree"]])
                size[r["fold"]] = size.get(r["fold"], 0) + 5 * sum(map(len, r["tree"]))
        pieces, room = [[]], _SHIPPED_NUMBERS
        for fold, n in size.items():
            if n > room and pieces[-1]:
                pieces.append([])
                room = _SHIPPED_NUMBERS
            pieces[-1].append(fold)
            room -= n
        columns = [F.col(c).cast("double") for c in self.features]
        total = F.lit(0.0)
        for folds in pieces:
            count = vote_counter({f: np.array(linear[f]).T for f in folds if f in linear},
                                 {f: grown[f] for f in folds if f in grown})
            total = total + count("fold", *columns)
        return df.withColumn("__votes", total)

    def _knn(self, df: DataFrame) -> DataFrame:
        """Batches of bounded size go to the tasks and the rows stay where they are; longer ones meet the rows block by block."""
        nodes = self.nodes.filter(F.col("kind") == "knn").select("fold", "kind_no", "attempt", "train_batch", neighbours().alias("k"))
        if nodes.count() * self.batch_len * (len(self.features) + 1) <= _SHIPPED_NUMBERS:
            return df.withColumn("__votes", near_counter(self._near_batches(nodes))("fold", *[F.col(c).cast("double") for c in self.features]))
        total = None
        for kind_no in sorted(r[0] for r in nodes.select("kind_no").distinct().collect()):
            own = nodes.filter(F.col("kind_no") == kind_no)
            train = self.batch_rows.filter("side = 'train'").join(
                F.broadcast(own.select("fold", "attempt", F.col("train_batch").alias("batch"))), ["fold", "batch"]
            )
            queries = df.select("fold", self.row_id, *self.features).join(
                F.broadcast(own.select("fold", "attempt")), "fold"
            )
            k = most_neighbours(self.specs[kind_no])
            found = nearest(queries, train, ["fold", "attempt"], self.features, "y", self.row_id, "slot", k,
                            df.count(), self.batch_len)
            found = nearest_of_each(found, F.broadcast(own.select("fold", "attempt", "k")), self.row_id, "slot")
            part = knn_votes(found, ["fold", "attempt"], self.row_id).groupBy("fold", self.row_id).agg(
                F.sum("vote").cast("double").alias("__votes")
            )
            total = part if total is None else total.unionByName(part)
        total = total.groupBy("fold", self.row_id).agg(F.sum("__votes").alias("__votes"))
        return df.join(total, ["fold", self.row_id], "left")

    def _near_batches(self, nodes: DataFrame) -> dict:
        """``fold -> [(features, classes, k)]`` of the batches behind the nodes, in the order of their slots."""
        tries = [(r["fold"], r["train_batch"], r["k"]) for r in nodes.collect()]
        used = nodes.select("fold", F.col("train_batch").alias("batch")).distinct()
        rows = self.batch_rows.filter("side = 'train'").join(F.broadcast(used), ["fold", "batch"])
        found = rows.select("fold", "batch", "slot", "y", *self.features).orderBy("fold", "batch", "slot").toPandas()
        parts = {key: (part[self.features].to_numpy(dtype=float), part["y"].to_numpy()) for key, part in found.groupby(["fold", "batch"], sort=False)}
        out: dict = {}
        for fold, batch, k in tries:
            out.setdefault(fold, []).append((*parts[(fold, batch)], k))
        return out


def near_counter(batches: dict):
    """Function of ``(fold, features…)`` that counts the fold's nearest-neighbour nodes voting 1."""

    @F.pandas_udf("double")
    def count_votes(fold: pd.Series, *x: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(dtype=float) for c in x])
        out = np.zeros(len(fold))
        for f, at in fold.groupby(fold, sort=False).indices.items():
            for rows, labels, k in batches.get(f, ()):
                out[at] += batch_votes(values[at], rows, labels, k)
        return pd.Series(out)

    return count_votes


def vote_counter(linear: dict, grown: dict):
    """Function of ``(fold, features…)`` that counts the fold's nodes voting 1."""

    @F.pandas_udf("double")
    def count_votes(fold: pd.Series, *x: pd.Series) -> pd.Series:
        values = np.column_stack([np.ones(len(fold)), *[c.to_numpy(dtype=float) for c in x]])
        out = np.zeros(len(fold))
        for f, at in fold.groupby(fold, sort=False).indices.items():
            rows = values[at]
            if f in linear:
                out[at] += (rows @ linear[f] > 0).sum(axis=1)
            for forest in grown.get(f, ()):
                out[at] += trees.forest_votes(rows[:, 1:], forest)
        return pd.Series(out)

    return count_votes


def joined_linear_votes(df: DataFrame, nodes: DataFrame, features, row_id: str) -> DataFrame:
    """Number of linear nodes voting 1 for each row, by a join of rows to their fold's nodes."""
    votes = (
        df.select("fold", row_id, *features)
        .join(nodes, "fold")
        .groupBy("fold", row_id)
        .agg(F.sum(linear_vote(features, F.col("intercept"), F.col("coef"))).cast("double").alias("__votes"))
    )
    return df.join(votes, ["fold", row_id], "left")
