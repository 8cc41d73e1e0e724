"""Queries: votes, thresholds, scores per fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog.registry import FX_ORDERS, h, query
from strataloom.catalog.views import fx_orders
from strataloom.functions.hashing import hash60
from strataloom.operators import ensemble, metrics

# Scored rows: vote share and weight follow from the row, the fold is the segment.
_SCORED = f"""
select segment as fold, row_id, target as y, (row_id * 7919 % 101) / 100.0::double as proba,
       row_id % 3 + 1 as w from ({FX_ORDERS})
"""
_PREDICTED = f"select *, cast(case when proba > 0.5::double then 1 else 0 end as integer) as pred from ({_SCORED})"
# Scored rows in which every second fold has one class only.
_ONE_CLASS = f"select * from ({_PREDICTED}) where y = 1 or fold in ('BUILDING', 'MACHINERY')"


def scored(spark, folder):
    return fx_orders(spark, folder).select(
        F.col("segment").alias("fold"), "row_id", F.col("target").alias("y"),
        ((F.col("row_id") * 7919 % 101) / F.lit(100.0)).alias("proba"), (F.col("row_id") % 3 + 1).alias("w"),
    )


def predicted(spark, folder):
    return metrics.classify(scored(spark, folder), 0.5)


def one_class(spark, folder):
    return predicted(spark, folder).filter((F.col("y") == 1) | F.col("fold").isin("BUILDING", "MACHINERY"))


def rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@query("vote_share", f"""
select segment as fold, row_id, round(avg({h("'vote'", 'row_id', 'node')} % 2), 6) as proba
from ({FX_ORDERS}), range(7) n(node) group by segment, row_id""")
def vote_share(spark, folder):
    votes = (
        fx_orders(spark, folder)
        .select(F.col("segment").alias("fold"), "row_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("node"))
        .withColumn("vote", hash60("vote", F.col("row_id"), F.col("node")) % 2)
    )
    return rounded(metrics.vote_share(votes), "fold", "row_id")


@query("thresholded", f"select fold, row_id, pred from ({_PREDICTED})")
def thresholded(spark, folder):
    return predicted(spark, folder).select("fold", "row_id", "pred")




@query("fold_rates", f"""
with e as (select fold, pred, y from ({_PREDICTED}), lateral (select unnest(range(w))) c)
select fold, round(avg(case when pred = y then 1.0::double else 0 end), 6) as accuracy,
       round(avg(case when y = 1 then 1 - pred end)::double, 6) as fnr,
       round(avg(case when y = 0 then pred end)::double, 6) as fpr
from e group by fold""")
def fold_rates(spark, folder):
    return rounded(metrics.fold_rates(predicted(spark, folder), "y", "w"), "fold")


@query("fold_rates_one_class", f"""
select fold, round(avg(case when pred = y then 1.0::double else 0 end), 6) as accuracy,
       round(avg(case when y = 1 then 1 - pred end)::double, 6) as fnr,
       round(avg(case when y = 0 then pred end)::double, 6) as fpr
from ({_ONE_CLASS}) group by fold""")
def fold_rates_one_class(spark, folder):
    return rounded(metrics.fold_rates(one_class(spark, folder), "y"), "fold")


def pair_auc(source: str, weight: str) -> str:
    """AUC by counting (positive, negative) pairs."""
    return f"""
with p as (select fold, proba, sum({weight}) as w from ({source}) where y = 1 group by fold, proba),
n as (select fold, proba, sum({weight}) as w from ({source}) where y = 0 group by fold, proba),
f as (select distinct fold from ({source}))
select f.fold, sum(p.w * n.w * (case when p.proba > n.proba then 1.0 when p.proba = n.proba then 0.5 else 0.0 end)::double)
       / sum(p.w * n.w) as roc_auc
from f left join p on f.fold = p.fold left join n on f.fold = n.fold group by f.fold"""


@query("fold_auc", f"select fold, round(roc_auc, 6) as roc_auc from ({pair_auc(_PREDICTED, 'w')})")
def fold_auc(spark, folder):
    return rounded(metrics.fold_auc(predicted(spark, folder), "y", "w"), "fold")


@query("strata_auc", f"""
select a.fold, round(coalesce(a.roc_auc, b.accuracy), 6) as roc_auc
from ({pair_auc(_ONE_CLASS, '1')}) a
join (select fold, avg(case when pred = y then 1.0::double else 0 end) as accuracy
      from ({_ONE_CLASS}) group by fold) b on a.fold = b.fold""")
def strata_auc(spark, folder):
    return rounded(metrics.strata_auc(one_class(spark, folder), "y"), "fold")


@query("strata_weight", f"""
select f.segment as fold, round(count(*) filter (where s.segment = f.segment)::double / count(*), 6) as strata_weight
from ({FX_ORDERS}) s, (select distinct segment from ({FX_ORDERS})) f group by f.segment""")
def strata_weight(spark, folder):
    # one count per segment; every other segment is on the fit side of a fold
    counts = fx_orders(spark, folder).groupBy("segment").agg(F.count("*").alias("n"))
    names = sorted(r["segment"] for r in counts.select("segment").collect())
    members = counts.withColumn("fold", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn(
        "role", F.when(F.col("fold") == F.col("segment"), "val").otherwise("fit")
    )
    return rounded(metrics.strata_weight(members, "n"), "fold")


@query("mean_scores", f"""
with e as (select fold, pred, y from ({_ONE_CLASS})),
s as (select fold, avg(case when pred = y then 1.0::double else 0 end) as accuracy,
             avg(case when y = 1 then 1 - pred end)::double as fnr,
             avg(case when y = 0 then pred end)::double as fpr from e group by fold)
select round(avg(accuracy), 6) as accuracy, round(avg(fnr), 6) as fnr, round(avg(fpr), 6) as fpr from s""")
def mean_scores(spark, folder):
    stats = metrics.fold_rates(one_class(spark, folder), "y")
    return rounded(metrics.report(stats, ["accuracy", "fnr", "fpr"]))


# Node scores that follow from the orders: one node per order, one fold per segment.
_NODES = f"""
select segment as fold, row_id as attempt, row_id as node, floor(amount / 1000) / 1000 as test_score,
       (row_id * 7919 % 11) / 10.0::double as train_score from ({FX_ORDERS})
"""


def nodes(spark, folder):
    return fx_orders(spark, folder).select(
        F.col("segment").alias("fold"), F.col("row_id").alias("attempt"), F.col("row_id").alias("node"),
        (F.floor(F.col("amount") / 1000) / F.lit(1000.0)).alias("test_score"),
        ((F.col("row_id") * 7919 % 11) / F.lit(10.0)).alias("train_score"),
    )


@query("accepted_attempts", f"""
select fold, attempt, round(test_score, 6) as test_score from (
  select *, row_number() over (partition by fold order by attempt) as n from ({_NODES}) where test_score >= 0.2::double)
where n <= 100""")
def accepted_attempts(spark, folder):
    return rounded(ensemble.accept(nodes(spark, folder), 0.2, 100).select("fold", "attempt", "test_score"), "fold", "attempt")


@query("best_nodes", f"""
select fold, node, round(test_score, 6) as test_score, round(train_score, 6) as train_score from (
  select *, row_number() over (partition by fold order by test_score desc, train_score desc, node) as n from ({_NODES}))
where n <= 100""")
def best_nodes(spark, folder):
    return rounded(ensemble.keep_best(nodes(spark, folder), 100).drop("attempt"), "fold", "node")
