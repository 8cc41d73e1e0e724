"""Queries: learners, ensembles, experiments."""

from __future__ import annotations

import math
from importlib.resources import files

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.catalog.draws import (
    BALANCED_SQL,
    BATCH_LEN,
    BATCHES_SQL,
    HOLDOUT_SQL,
    N_BATCHES,
    SEED,
    STRATA_SQL,
    TEST_BATCHES_SQL,
    TEST_SEED,
    TEST_SIZE,
)
from strataloom.catalog.metrics import pair_auc, rounded
from strataloom.catalog.registry import FRAMES, FX_FRAMES, FX_ORDERS, SQL, SUBJECTS, h, query
from strataloom.catalog.subjects import scratch
from strataloom.catalog.views import fx_frames, fx_orders
from strataloom.config import StudySettings
from strataloom.materialize import pin
from strataloom.operators import ensemble, newton, sampling, trees
from strataloom.operators.knn import knn_votes, nearest
from strataloom.operators.ridge import ridge_grams, score_linear, solve_ridge
from strataloom.plans import jobs
from strataloom.plans.experiment import HoldoutExperiment, LeaveStratumOutExperiment, StratifiedExperiment

# Ridge of the target on one feature, for each segment and several penalties.
_SIGNED = f"select segment as fold, row_id, target, 2 * target - 1 as y, amount / 100000 as x from ({FX_ORDERS})"
_RIDGE = f"""
select fold, attempt, alpha, sxy / (sxx + alpha) as coef, my - sxy / (sxx + alpha) * mx as intercept from (
  select fold, avg(x) as mx, avg(y) as my, var_pop(x) * count(*) as sxx, covar_pop(x, y) * count(*) as sxy
  from ({_SIGNED}) group by fold), (select attempt, 1.2::double * 10 ** attempt as alpha from range(5) a(attempt))
"""


def _ridge_nodes(spark, folder):
    rows = fx_orders(spark, folder).select(
        F.col("segment").alias("fold"), "row_id", "target", (F.col("amount") / 100000).alias("x")
    )
    attempts = (
        rows.select("fold").distinct()
        .withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
        .withColumn("alpha", F.lit(1.2) * F.pow(F.lit(10.0), "attempt"))
    )
    return rows, solve_ridge(ridge_grams(rows, ["fold"], ["x"], "target"), attempts, ["fold"], 1)


@query("ridge", f"select fold, attempt, round(coef, 6) as coef, round(intercept, 6) as intercept from ({_RIDGE})")
def ridge(spark, folder):
    _, nodes = _ridge_nodes(spark, folder)
    return nodes.select(
        "fold", "attempt", F.round(F.get("coef", F.lit(0)), 6).alias("coef"), F.round("intercept", 6).alias("intercept")
    )


@query("node_accuracy", f"""
select s.fold, n.attempt, round(avg(case when (intercept + coef * x > 0) = (target = 1) then 1.0::double else 0 end), 6)
       as accuracy
from ({_SIGNED}) s join ({_RIDGE}) n on s.fold = n.fold group by s.fold, n.attempt""")
def node_accuracy(spark, folder):
    rows, nodes = _ridge_nodes(spark, folder)
    return rounded(score_linear(nodes, rows, {"fold": "fold"}, ["x"], "target", "accuracy"), "fold", "attempt")


_VOTES_SQL = f"""
select s.fold, s.row_id, round(avg(case when intercept + coef * x > 0 then 1.0::double else 0 end), 6) as proba
from ({_SIGNED}) s join ({_RIDGE}) n on s.fold = n.fold group by s.fold, s.row_id
"""


def _linear_ensemble(spark, folder):
    rows, nodes = _ridge_nodes(spark, folder)
    numbered = nodes.select(
        "*", F.lit("Ridge").alias("kind"), F.col("attempt").alias("node"), F.lit(None).cast(trees.TREE_TYPE).alias("tree")
    )
    return rows, ensemble.FittedEnsemble(numbered, 5, ["x"], "target", "row_id", rows, 0, [])


@query("ensemble_votes", _VOTES_SQL)
def ensemble_votes(spark, folder):
    rows, fitted = _linear_ensemble(spark, folder)
    return rounded(fitted.predict_proba(rows).select("fold", "row_id", "proba"), "fold", "row_id")


@query("ensemble_classes", f"select fold, row_id, cast(proba > 0.5::double as integer) as pred from ({_VOTES_SQL})")
def ensemble_classes(spark, folder):
    rows, fitted = _linear_ensemble(spark, folder)
    return fitted.predict(rows, 0.5).select("fold", "row_id", "pred")


@query("ensemble_votes_joined", _VOTES_SQL)
def ensemble_votes_joined(spark, folder):
    rows, fitted = _linear_ensemble(spark, folder)
    nodes = fitted.nodes.select("fold", "node", "intercept", "coef")
    votes = ensemble.joined_linear_votes(rows, nodes, ["x"], "row_id")
    return votes.select("fold", "row_id", F.round(F.col("__votes") / 5, 6).alias("proba"))


_DISTANCE = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in FRAMES)


@query("knn", f"""
with o as (select target as class, row_id, count(*) over (partition by target) as n,
                  row_number() over (partition by target order by {h('row_id')}, row_id) - 1 as position
           from ({FX_FRAMES})),
c as (select distinct class, n from o),
d as (select class, slot, {h(f"'{SEED}'", "'batch'", 'class', '0', 'slot')} % n as position
      from c, range(100) s(slot)),
f as (select * from ({FX_FRAMES})),
t as (select distinct f.* from d join o on d.class = o.class and d.position = o.position join f on o.row_id = f.row_id),
r as (select q.row_id, t.target, row_number() over (partition by q.row_id order by {_DISTANCE}, t.row_id) as nth
      from f q, t)
select row_id, cast(avg(target) > 0.5 as integer) as vote from r where nth <= 5 group by row_id""")
def knn(spark, folder):
    frames = fx_frames(spark, folder)
    batch = sampling.generate_batches(frames, 1, 200, "target", "row_id", FRAMES, seed=SEED)
    train = frames.join(F.broadcast(batch.draws.select("row_id").distinct()), "row_id").withColumn("fold", F.lit(0))
    queries = frames.withColumn("fold", F.lit(0))
    found = nearest(queries, train.withColumnRenamed("row_id", "train_id"), ["fold"], FRAMES, "target", "row_id",
                    "train_id", 5, queries.count(), 200)
    return knn_votes(found, ["fold"], "row_id").select("row_id", "vote")


# Newton rounds on (intercept, coefficient) for every batch and C, from zero; more rounds than any of them needs.
_ROUNDS = 14
_LOSSES_SQL = {  # curvature and slope of a row's loss at the margin f
    "logistic": ("greatest(exp(-abs(f)) / ((1 + exp(-abs(f))) * (1 + exp(-abs(f)))), 1e-12)", "1 / (1 + exp(-f)) - y"),
    "SVM": ("case when s * f < 1 then 2.0::double else 0 end", "case when s * f < 1 then -2 * s * (1 - s * f) else 0 end"),
}


def _linear_sql(kind: str) -> str:
    h, g = _LOSSES_SQL[kind]
    steps = ["n0 as (select batch, c, 0::double as b0, 0::double as b1 from (select distinct batch from t), (select 10.0::double ** (k - 1) as c from range(3) a(k)))"]
    for i in range(_ROUNDS):
        steps.append(f"""
n{i + 1} as (select batch, c, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b1 from (
  select batch, c, b0, b1, c * sum(h) as h00, c * sum(h * x) as h01, 1 + c * sum(h * x * x) as h11, c * sum(g) as g0, b1 + c * sum(g * x) as g1 from (
    select *, {h} as h, {g} as g from (select n.*, t.x, t.y, 2 * t.y - 1 as s, b0 + b1 * t.x as f from n{i} n join t on n.batch = t.batch)) group by batch, c, b0, b1))""")
    return f"""
with t as (select d.batch, s.target as y, s.amount / 100000 as x from ({BATCHES_SQL}) d join ({FX_ORDERS}) s on d.row_id = s.row_id),
{", ".join(steps)}
select row_id, round(avg(case when b0 + b1 * amount / 100000 > 0 then 1.0::double else 0 end), 6) as proba from n{_ROUNDS}, ({FX_ORDERS}) group by row_id"""


def _batch_rows(spark, folder):
    """The balanced batches as ``fold`` 0: rows with ``batch, slot, y`` and one feature."""
    signals = fx_orders(spark, folder)
    batches = sampling.generate_batches(signals, N_BATCHES, BATCH_LEN, "target", "row_id", ["amount"], seed=SEED)
    drawn = sampling.fetch_rows(batches.draws, signals, "row_id", batches.n_rows_bound)
    return drawn.select(F.lit(0).alias("fold"), F.col("batch").cast("bigint").alias("batch"), F.col("target").alias("y"), (F.col("amount") / 100000).alias("x"), "amount")


def _linear_learner(kind: str, name: str):
    @query(name, _linear_sql(kind))
    def run(spark, folder):
        """A node for every batch and three strengths of the penalty; all of them vote."""
        rows = _batch_rows(spark, folder)
        tries = spark.range(3 * N_BATCHES).select(
            F.lit(0).alias("fold"), F.col("id").alias("attempt"), F.floor(F.col("id") / 3).alias("batch"), F.pow(F.lit(10.0), F.col("id") % 3 - 1).alias("c"),
            F.lit(True).alias("fit_intercept"), F.lit(newton.MAX_ROUNDS).alias("max_iter"))
        nodes = newton.fit_linear(kind, rows, tries, ["x"]).withColumn("kind", F.lit(kind)).withColumn("tree", F.lit(None).cast(trees.TREE_TYPE))
        fitted = ensemble.FittedEnsemble(nodes, 3 * N_BATCHES, ["x"], "target", "row_id", rows, 0, [])
        signals = fx_orders(spark, folder).withColumn("x", F.col("amount") / 100000)
        return fitted.predict_proba(signals).select("row_id", F.round("proba", 6).alias("proba"))

    return run


_linear_learner("logistic", "logistic_votes")
_linear_learner("SVM", "linear_svm_votes")

# Trees of depth two on one batch of the frames, level by level.
_TREE_BATCH, _TREE_LEAF = 2000, 30


def _weight_sql(seed: int) -> str:
    total, term, parts = 0.0, math.exp(-1.0), []
    for k in range(1, 15):
        total += term
        term /= k
        parts.append(f"case when u >= {total!r}::double then 1 else 0 end")
    return f"(select {' + '.join(parts)} from (select {h(f"'{seed}'", "'bag'", 'tree', 'slot')}::double / 1152921504606846976::double as u))"


def _trees_sql(n_trees: int, n_features: int, depth: int, bootstrap: bool) -> str:
    p = len(FRAMES)
    weight = _weight_sql(SEED) if bootstrap else "1"
    values = ", ".join(f"cast({c} as double)" for c in FRAMES)
    parts = [f"""
f as (select row_id, target as y, [{values}] as x from ({FX_FRAMES})),
o as (select target as class, row_id, count(*) over (partition by target) as n,
             row_number() over (partition by target order by {h('row_id')}, row_id) - 1 as position from ({FX_FRAMES})),
c as (select distinct class, n from o),
d as (select class, slot, {h(f"'{SEED}'", "'batch'", 'class', '0', 'slot')} % n as position from c, range({_TREE_BATCH // 2}) s(slot)),
b as (select row_number() over (order by f.row_id) as slot, f.y, f.x from d join o on d.class = o.class and d.position = o.position join f on f.row_id = o.row_id),
r0 as (select tree, slot, y, x, '' as path, {weight} as w from b, range({n_trees}) t(tree))"""]
    for i in range(depth):
        parts.append(f"""
k{i} as (select tree, path, sum(w) as n, sum(w * y) as pos from r{i} where w > 0 group by tree, path having sum(w) >= {2 * _TREE_LEAF} and sum(w * y) not in (0, sum(w))),
l{i} as (select * from (select k.*, f, row_number() over (partition by tree, path order by {h(f"'{SEED}'", "'split'", 'tree', 'path', 'f')}, f) as place from k{i} k, range({p}) a(f))),
v{i} as (select l.tree, l.path, l.n, l.pos, l.f, l.place, r.x[l.f + 1] as v, sum(w) as m, sum(w * y) as hits
         from l{i} l join r{i} r on r.tree = l.tree and r.path = l.path where w > 0 group by all),
s{i} as (select *, sum(m) over o as ln, sum(hits) over o as lp, lead(v) over o as following from v{i} window o as (partition by tree, path, f order by v)),
g{i} as (select *, round((lp - lp::double * lp / ln) + ((pos - lp) - (pos - lp)::double * (pos - lp) / (n - ln)), 9) as cost
         from s{i} where following is not null and ln >= {_TREE_LEAF} and n - ln >= {_TREE_LEAF}),
q{i} as (select tree, path, f, (v + following) / 2 as cut from (
  select *, row_number() over (partition by tree, path order by case when place <= {n_features} then 0 else place end, cost, f, v) as nth from g{i}) where nth = 1),
r{i + 1} as (select r.tree, r.slot, r.y, r.x, r.w, r.path || case when q.f is null then '' when r.x[q.f + 1] <= q.cut then '0' else '1' end as path
             from r{i} r left join q{i} q on r.tree = q.tree and r.path = q.path),
w{i + 1} as (select u.tree, u.row_id, u.x, u.path || case when q.f is null then '' when u.x[q.f + 1] <= q.cut then '0' else '1' end as path
             from {f'w{i}' if i else f"(select tree, row_id, x, '' as path from f, range({n_trees}) t(tree))"} u left join q{i} q on u.tree = q.tree and u.path = q.path)""")
    return f"""
with {", ".join(parts)},
e as (select tree, path, sum(w * y)::double / sum(w) as share from r{depth} where w > 0 group by tree, path)
select row_id, cast(round(avg(share), 9) > 0.5 as integer) as vote from w{depth} w join e on w.tree = e.tree and w.path = e.path group by row_id"""


def _tree_learner(name: str, n_trees: int, n_features: int, depth: int, bootstrap: bool):
    @query(name, _trees_sql(n_trees, n_features, depth, bootstrap))
    def run(spark, folder):
        """Grown on one batch of the frames, ranges of few values; all rows are voted on."""
        frames = fx_frames(spark, folder)
        batch = sampling.generate_batches(frames, 1, _TREE_BATCH, "target", "row_id", FRAMES, seed=SEED)
        drawn = sampling.fetch_rows(batch.draws, frames, "row_id", batch.n_rows_bound)
        slot = F.row_number().over(Window.orderBy("row_id"))  # one batch, of a length given here
        rows = drawn.select("row_id", F.col("target").alias("y"), slot.cast("bigint").alias("slot"), F.array(*[F.col(c).cast("double") for c in FRAMES]).alias("x"))
        rows = rows.select(F.lit(0).alias("fold"), F.lit(0).cast("bigint").alias("attempt"), F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), "slot", "y", "x")
        weight = trees.poisson_weight(SEED, "bag", F.col("tree"), F.col("slot")) if bootstrap else F.lit(1).cast("bigint")
        tries = spark.range(1).select(
            F.lit(0).alias("fold"), F.col("id").alias("attempt"), F.lit(SEED).cast("bigint").alias("seed"), F.lit(depth).alias("max_depth"),
            F.lit(n_features).alias("n_features"), F.lit(_TREE_LEAF).cast("bigint").alias("min_leaf"), F.lit(2).cast("bigint").alias("min_split"))
        nodes, _ = trees.grow(pin(rows.withColumn("w", weight)), tries, len(FRAMES), range_rows=500)
        grown = trees.as_arrays(nodes).select("fold", "tree", F.lit(name).alias("kind"), F.lit(None).cast("double").alias("intercept"), F.lit(None).cast("array<double>").alias("coef"))
        fitted = ensemble.FittedEnsemble(grown, 1, FRAMES, "target", "row_id", rows, 0, [])
        return fitted.predict(frames).select("row_id", F.col("pred").alias("vote"))

    return run


_tree_learner("tree_votes", 1, 4, 2, False)
_tree_learner("forest_votes", 7, 3, 2, True)


@query("tree_stumps", f"""
with s as (select d.batch, s.amount as x, s.target as y from ({BATCHES_SQL}) d join ({FX_ORDERS}) s on d.row_id = s.row_id),
v as (select batch, x, count(*) as n, sum(y) as p from s group by batch, x),
c as (select batch, x, lead(x) over w as next_x, sum(n) over w as ln, sum(p) over w as lp,
             sum(n) over (partition by batch) as n, sum(p) over (partition by batch) as p
      from v window w as (partition by batch order by x)),
g as (select *, round((lp - lp::double * lp / ln) + ((p - lp) - (p - lp)::double * (p - lp) / (n - ln)), 9) as cost
      from c where next_x is not null and ln >= 50 and n - ln >= 50),
b as (select *, row_number() over (partition by batch order by cost, x) as nth from g)
select cast(batch as bigint) as batch, round((x + next_x) / 2, 6) as threshold, cast(2 * lp > ln as integer) as left_vote,
       cast(2 * (p - lp) > n - ln as integer) as right_vote
from b where nth = 1""")
def tree_stumps(spark, folder):
    """One-split trees on the balanced batches: the split of least impurity."""
    rows = _batch_rows(spark, folder).select(
        "fold", F.col("batch").alias("attempt"), F.lit(0).alias("tree"), "y", F.lit(1).cast("bigint").alias("w"), F.array("amount").alias("x"))
    tries = rows.select("fold", "attempt").distinct().select(
        "*", F.lit(0).cast("bigint").alias("seed"), F.lit(1).alias("max_depth"), F.lit(1).alias("n_features"), F.lit(50).cast("bigint").alias("min_leaf"), F.lit(2).cast("bigint").alias("min_split"))
    nodes, _ = trees.grow(rows, tries, 1)

    def at(path: str, value):
        return F.max(F.when(F.col("path") == path, value))

    return nodes.groupBy(F.col("attempt").alias("batch")).agg(
        F.round(at("", F.col("threshold")), 6).alias("threshold"),
        at("0", (trees.share() > 0.5).cast("int")).alias("left_vote"), at("1", (trees.share() > 0.5).cast("int")).alias("right_vote"))


def study_settings(kinds=("Ridge",), sizes=(8,), params=({"alpha": {"range": [0.5, 2.0]}},), get_best=5, inputs=("amount",),
                   encoders=False, frames=(), target="target") -> StudySettings:
    """Settings for studies on the order signals."""
    inputs = list(inputs)
    return StudySettings.of(
        {"subject_id_column": "subject", "subject_data_columns": ["segment"], "target_variable": target},
        {"train_test_fraction": 0.8, "input_variables": inputs + list(frames), "target_variable": target,
         "n_train_batches": 6, "n_test_batches": 5, "train_batches_size": 200, "test_batches_size": 80},
        {"classifier_list": list(kinds), "node_sizes": list(sizes), "kwargs_list": list(params), "score_cap": 0.4,
         "get_best": get_best, "class_threshold": 0.5},
        {"Encoders": ["one_hot"] if encoders else [], "Encoders_kwargs": [{}] if encoders else [],
         "Encoders_input_columns": [["priority"]] if encoders else [],
         "Encoders_target_columns": [None] if encoders else [],
         "Normalizers": ["min_max_normalization"], "Normalizers_kwargs": [{}],
         "Normalizers_input_columns": [["amount"]],
         "Signal_compressor_clusters": [3] if frames else [],
         "Signal_compressor_input_columns": [list(frames)] if frames else [],
         "Signal_compressor_apply_estimators": ["median"] if frames else []},
    )


def _nodes_sql(folds: str, n_train: int, n_test: int) -> str:
    """CTEs from the batch rows ``br`` (fold, side, batch, y, x) to the ``best`` ridge nodes on one feature."""
    key = f"'{SEED}'", "'attempt'", "'0'", "a.fold", "attempt"
    return f"""g as (select fold, batch, avg(x) as mx, avg(2 * y - 1) as my, var_pop(x) * count(*) as sxx,
             covar_pop(x, 2 * y - 1) * count(*) as sxy from br where side = 'train' group by fold, batch),
a as (select a.fold, attempt, {h(*key, "'train'")} % {n_train} as train_batch, {h(*key, "'test'")} % {n_test} as test_batch,
             0.5::double + {h(*key, "'alpha'")}::double / 1152921504606846976::double * 1.5::double as alpha
      from {folds} a, range(40) t(attempt)),
nd as (select a.*, sxy / (sxx + alpha) as coef, my - sxy / (sxx + alpha) * mx as intercept
       from a join g on a.fold = g.fold and a.train_batch = g.batch),
sc as (select nd.*, (select avg(case when (nd.intercept + nd.coef * b.x > 0) = (b.y = 1) then 1.0::double else 0 end)
                     from br b where b.fold = nd.fold and b.side = 'test' and b.batch = nd.test_batch) as test_score,
              (select avg(case when (nd.intercept + nd.coef * b.x > 0) = (b.y = 1) then 1.0::double else 0 end)
                     from br b where b.fold = nd.fold and b.side = 'train' and b.batch = nd.train_batch) as train_score
       from nd),
ac as (select * from (select *, row_number() over (partition by fold order by attempt) as node
                      from sc where test_score >= 0.4::double) where node <= 8),
best as (select * from (select *, row_number() over (
           partition by fold order by test_score desc, train_score desc, node) as place from ac) where place <= 5)"""


def _study_sql(folds: str) -> str:
    """Scored validation rows of a study with one scaled feature and ridge nodes."""
    return f"""
with sig as ({FX_ORDERS}), sub as ({SUBJECTS}), f as ({folds}),
lim as (select fold, min(amount) as lo, max(amount) as hi from f join sig on f.subject = sig.subject
        where role = 'fit' group by fold),
io as (select f.fold, f.subject, s.target as class, f.n_draws,
              count(*) over (partition by fold, s.target) as n, count(*) over (partition by fold) as n_fold,
              row_number() over (partition by fold, s.target order by {h('f.subject')}, f.subject) - 1 as position
       from f join sub s on f.subject = s.subject where f.role = 'fit'),
ic as (select distinct fold, class, n, n_fold from io),
ik as (select fold, least(min(n), cast(ceil((1.0::double - 0.8::double) * max(n_fold)) as bigint)) as k from ic group by fold),
id as (select ic.fold, ic.class, {h(f"'{SEED}'", "'inner'", 'ic.fold', 'ic.class', 'slot')} % ic.n as position
       from ic join ik on ic.fold = ik.fold, lateral (select unnest(range(ik.k)) as slot) s),
it as (select fold, class, position, count(*) as times from id group by fold, class, position),
m as (select io.fold, io.subject, case when it.times is null then 'train' else 'test' end as side,
             io.n_draws * coalesce(it.times, 1) as w
      from io left join it on io.fold = it.fold and io.class = it.class and io.position = it.position),
po as (select m.fold, m.side, s.target as class, s.amount,
              count(*) over (partition by m.fold, m.side, s.target) as n,
              row_number() over (partition by m.fold, m.side, s.target order by {h('m.subject')}, m.subject, {h('s.row_id')}, s.row_id, copy) - 1 as position
       from m join sig s on m.subject = s.subject, lateral (select unnest(range(m.w)) as copy) x),
pc as (select distinct fold, side, class, n from po),
pd as (select fold, side, class, batch,
              {h(f"'{SEED}'", "'batch'", 'fold', 'side', 'class', 'batch', 'slot')} % n as position
       from pc, range(6) b(batch), range(100) s(slot) where side = 'train' or (slot < 40 and batch < 5)),
br as (select d.fold, d.side, d.batch, d.class as y, (o.amount - lo) / (hi - lo) as x
       from pd d join po o on d.fold = o.fold and d.side = o.side and d.class = o.class and d.position = o.position
       join lim on d.fold = lim.fold),
{_nodes_sql("(select distinct fold from f)", 6, 5)},
val as (select f.fold, f.n_draws as w, s.row_id, s.target as y, (s.amount - lo) / (hi - lo) as x
        from f join sig s on f.subject = s.subject join lim on f.fold = lim.fold where f.role = 'val')
select v.fold, v.row_id, v.y, v.w, avg(case when intercept + coef * x > 0 then 1.0::double else 0 end) as proba,
       cast(avg(case when intercept + coef * x > 0 then 1.0::double else 0 end) > 0.5::double as integer) as pred
from val v join best on v.fold = best.fold group by v.fold, v.row_id, v.y, v.w
"""


def _rates_sql(scored: str) -> str:
    return f"""
select fold, round(avg(case when pred = y then 1.0::double else 0 end), 6) as accuracy,
       round(avg(case when y = 1 then 1 - pred end)::double, 6) as fnr,
       round(avg(case when y = 0 then pred end)::double, 6) as fpr
from ({scored}), lateral (select unnest(range(w))) c group by fold"""


_TEST_BATCHES, _TEST_LEN = 10, 100


@query("sampled_ensemble_votes", f"""
with sig as (select row_id, target as y, amount / 100000 as x from ({FX_ORDERS})),
br as (select 0 as fold, 'train' as side, batch, y, x from ({BATCHES_SQL}) d join sig on d.row_id = sig.row_id
       union all select 0, 'test', batch, y, x from ({TEST_BATCHES_SQL}) d join sig on d.row_id = sig.row_id),
{_nodes_sql("(select 0 as fold)", N_BATCHES, _TEST_BATCHES)}
select sig.row_id, round(avg(case when intercept + coef * x > 0 then 1.0::double else 0 end), 6) as proba from sig, best group by sig.row_id""")
def sampled_ensemble_votes(spark, folder):
    """An ensemble fitted on two samplings that were drawn before."""
    signals = fx_orders(spark, folder).withColumn("x", F.col("amount") / 100000)
    train, test = (sampling.generate_batches(signals, n, size, "target", "row_id", ["x"], seed=seed)
                   for n, size, seed in ((N_BATCHES, BATCH_LEN, SEED), (_TEST_BATCHES, _TEST_LEN, TEST_SEED)))
    fitted = ensemble.Ensemble(["Ridge"], [8], [{"alpha": {"range": [0.5, 2.0]}}]).fit_samplings(signals, train, test, 0.4, 5, SEED)
    return rounded(fitted.predict_proba(signals).select("row_id", "proba"), "row_id")


def _signals(spark, folder):
    return fx_orders(spark, folder)


@query("leave_stratum_out_scores", _rates_sql(_study_sql(STRATA_SQL)))
def leave_stratum_out_scores(spark, folder):
    study = LeaveStratumOutExperiment(_signals(spark, folder), study_settings(), seed=SEED)
    return rounded(study.run("segment"), "fold")


@query("leave_stratum_out_vote_shares", f"""
select fold, row_id, y, round(proba, 6) as proba from ({_study_sql(STRATA_SQL)})""")
def leave_stratum_out_vote_shares(spark, folder):
    study = LeaveStratumOutExperiment(_signals(spark, folder), study_settings(), seed=SEED)
    study.run("segment")
    return rounded(study.predictions.select("fold", "row_id", "y", "proba"), "fold", "row_id", "y")


@query("holdout_scores", f"""
with s as ({_study_sql(HOLDOUT_SQL)})
select r.*, round(a.roc_auc, 6) as roc_auc from ({_rates_sql('select * from s')}) r
join ({pair_auc('select * from s', 'w')}) a on r.fold = a.fold""")
def holdout_scores(spark, folder):
    study = HoldoutExperiment(_signals(spark, folder), study_settings(), seed=SEED)
    return rounded(study.run(5, TEST_SIZE), "fold")


@query("stratified_scores", f"""
with s as ({_study_sql(BALANCED_SQL)}),
w as (select fold, sum(case when role = 'val' then n_draws else 0 end)::double / sum(n_draws) as strata_weight
      from ({BALANCED_SQL}) f join ({FX_ORDERS}) o on f.subject = o.subject group by fold)
select r.*, round(a.roc_auc, 6) as roc_auc, round(w.strata_weight, 6) as strata_weight
from ({_rates_sql('select * from s')}) r
join ({pair_auc('select * from s', 'w')}) a on r.fold = a.fold join w on r.fold = w.fold""")
def stratified_scores(spark, folder):
    study = StratifiedExperiment(_signals(spark, folder), study_settings(), seed=SEED)
    return rounded(study.run("segment", "target"), "fold")


def _full_signals(spark, folder):
    frames = fx_frames(spark, folder).select("row_id", *FRAMES)
    return fx_orders(spark, folder).join(frames, "row_id")


@query("mixed_study_scores")
def mixed_study_scores(spark, folder):
    """Encode, scale and compress; ridge, tree, kNN and logistic nodes vote together."""
    settings = study_settings(("Ridge", "tree", "knn", "logistic"), (8, 4, 2, 2),
                              ({"alpha": 1.2}, {"max_depth": 6, "min_samples_leaf": 5}, {"n_neighbors": (3, 8)}, {}), get_best=12,
                              inputs=("priority", "amount"), encoders=True, frames=FRAMES)
    study = HoldoutExperiment(_full_signals(spark, folder), settings, seed=SEED)
    return rounded(study.run(2, TEST_SIZE), "fold")


_SETTINGS = [str(files("strataloom.catalog") / "settings" / f"{name}.json") for name in ("subject", "sampler", "ensemble", "transformer")]


def _job_scores(spark, folder, job, *args):
    """Scores that a job saved: signals and settings from files, the results read back."""
    path = scratch(spark, "job")
    _signals(spark, folder).write.parquet(f"{path}/signals")
    job(spark, f"{path}/signals", _SETTINGS, *args, save_path=f"{path}/saved", seed=SEED)
    return rounded(spark.read.parquet(f"{path}/saved/*/stats"), "fold")


@query("job_holdout_scores", SQL["holdout_scores"])
def job_holdout_scores(spark, folder):
    return _job_scores(spark, folder, jobs.run_holdout, 5, TEST_SIZE)


@query("job_leave_stratum_out_scores", SQL["leave_stratum_out_scores"])
def job_leave_stratum_out_scores(spark, folder):
    return _job_scores(spark, folder, jobs.run_leave_stratum_out, "segment")


@query("job_stratified_scores", SQL["stratified_scores"])
def job_stratified_scores(spark, folder):
    return _job_scores(spark, folder, jobs.run_stratified, "segment", "target")
