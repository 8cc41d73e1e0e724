"""Queries: batches, balanced samples, folds, inner splits, attempts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.catalog.registry import FX_EVENTS, FX_FRAMES, FX_ORDERS, SUBJECTS, h, query
from strataloom.catalog.views import fx_events, fx_frames, fx_orders, subjects_of_orders
from strataloom.materialize import ensure_checkpoint_dir, pin
from strataloom.operators import ensemble, sampling
from strataloom.operators.draws import small_table
from strataloom.operators.folds import holdout_folds, strata_folds
from strataloom.operators.subjects import N_DRAWS
from strataloom.sources.samplings import load_sampling, save_sampling

SEED = 7
TEST_SIZE = 40
N_BATCHES = 20
BATCH_LEN = 400
# Batches are drawn by way of hash prefixes, as from groups too large for one window.
PREFIX_BITS = 6

# Rows of fx_orders in drawing order, per class and over all.
_ORDERED = f"""
select target as class, row_id, count(*) over (partition by target) as n,
       row_number() over (partition by target order by {h('row_id')}, row_id) - 1 as position
from ({FX_ORDERS})
"""
_ORDERED_ALL = f"""
select 'all' as class, row_id, count(*) over () as n,
       row_number() over (order by {h('row_id')}, row_id) - 1 as position
from ({FX_ORDERS})
"""


def _with_replacement(ordered: str, k: int, n_batches: int = N_BATCHES, seed=SEED) -> str:
    return f"""
with o as ({ordered}), c as (select distinct class, n from o),
d as (select class, cast(batch as integer) as batch, slot,
             {h(f"'{seed}'", "'batch'", 'class', 'batch', 'slot')} % n as position
      from c, range({n_batches}) b(batch), range({k}) s(slot))
select d.batch, o.row_id from d join o on d.class = o.class and d.position = o.position
"""


def _distinct(ordered: str, k: str, n_batches: int = N_BATCHES) -> str:
    """Slot 0 … k-1 under a keyed permutation of positions: four rounds, repeated while n or more."""

    def rounds(i: int, half: str) -> str:
        return h(f"'{SEED}'", "'batch'", "class", "batch", f"'{i}'", half)

    return f"""
with recursive o as ({ordered}),
c as (select class, n, a, (n + a - 1) // a as b
      from (select distinct class, n, cast(floor(sqrt(n)) as bigint) + 1 as a from o)),
w(class, batch, n, a, b, v, walked) as (
  select class, cast(batch as integer), n, a, b, cast(slot as bigint), 0
  from c, range({n_batches}) x(batch), lateral (select unnest(range({k})) as slot) s
  union all
  select class, batch, n, a, b, l2 * b + (r1 + {rounds(3, 'l2')}) % b, walked + 1 from (
  select *, (l1 + {rounds(2, 'r1')}) % a as l2 from (
  select *, (r0 + {rounds(1, 'l1')}) % b as r1 from (
  select *, (v // b + {rounds(0, 'r0')}) % a as l1 from (
  select *, v % b as r0 from w where walked = 0 or v >= n))))
)
select w.batch, o.row_id from w join o on w.class = o.class and w.v = o.position
where w.walked > 0 and w.v < w.n
"""


BATCHES_SQL = _with_replacement(_ORDERED, BATCH_LEN // 2)
TEST_SEED = 8
TEST_BATCHES_SQL = _with_replacement(_ORDERED, 50, 10, TEST_SEED)


@query("batches_balanced", BATCHES_SQL)
def batches_balanced(spark, folder):
    return _batches(spark, folder).draws


def _batches(spark, folder, **kw):
    return sampling.generate_batches(
        fx_orders(spark, folder), kw.pop("n_batches", N_BATCHES), kw.pop("batch_len", BATCH_LEN), "target", "row_id",
        kw.pop("inputs", ["priority", "amount"]), seed=kw.pop("seed", SEED), bits=PREFIX_BITS, **kw
    )


@query("batches_balanced_distinct", _distinct(_ORDERED, BATCH_LEN // 2))
def batches_balanced_distinct(spark, folder):
    return _batches(spark, folder, resample=False).draws


@query("batches_balanced_distinct_whole_class", _distinct(_ORDERED, "(select min(n) from c)", 5))
def batches_balanced_distinct_whole_class(spark, folder):
    signals = fx_orders(spark, folder)
    return sampling.generate_batches(
        signals, 5, 1_000_000_000, "target", "row_id", ["amount"], resample=False, seed=SEED, bits=PREFIX_BITS
    ).draws


@query("batches_unbalanced", _with_replacement(_ORDERED_ALL, BATCH_LEN))
def batches_unbalanced(spark, folder):
    return _batches(spark, folder, balanced=False).draws


@query("batches_unbalanced_distinct", _distinct(_ORDERED_ALL, BATCH_LEN))
def batches_unbalanced_distinct(spark, folder):
    return _batches(spark, folder, balanced=False, resample=False).draws


@query("batch_inputs", f"""
select s.row_id, s.priority, s.amount from ({_with_replacement(_ORDERED, BATCH_LEN // 2)}) d
join ({FX_ORDERS}) s on d.row_id = s.row_id where d.batch = 3""")
def batch_inputs(spark, folder):
    return _batches(spark, folder).extract_batch(fx_orders(spark, folder), 3)


@query("batch_target", f"""
select s.row_id, s.target from ({_with_replacement(_ORDERED, BATCH_LEN // 2)}) d
join ({FX_ORDERS}) s on d.row_id = s.row_id where d.batch = 3""")
def batch_target(spark, folder):
    return _batches(spark, folder).extract_batch(fx_orders(spark, folder), 3, y=True)


@query("drawn_rows", f"""
select d.batch, s.row_id, s.target, s.amount from ({_with_replacement(_ORDERED, BATCH_LEN // 2)}) d
join ({FX_ORDERS}) s on d.row_id = s.row_id""")
def drawn_rows(spark, folder):
    batches = _batches(spark, folder)
    rows = fx_orders(spark, folder).select("row_id", "target", "amount")
    return sampling.fetch_rows(batches.draws, rows, "row_id", batches.n_rows_bound)


@query("combined_samplings", f"""
select batch, row_id from ({_with_replacement(_ORDERED, BATCH_LEN // 2)})
union all
select cast(batch + {N_BATCHES} as integer), row_id
from ({_with_replacement(_ORDERED_ALL, 100, n_batches=5, seed=SEED + 1)})""")
def combined_samplings(spark, folder):
    other = _batches(spark, folder, n_batches=5, batch_len=100, balanced=False, seed=SEED + 1)
    return _batches(spark, folder).combine(other).draws


@query("saved_sampling", _with_replacement(_ORDERED, BATCH_LEN // 2))
def saved_sampling(spark, folder):
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/samplings-{uuid.uuid4().hex}"
    save_sampling(_batches(spark, folder), base, "batches")
    return load_sampling(spark, base, "batches").draws


@query("balanced_sample", f"""
with o as (select target as class, row_id, count(*) over (partition by target) as n,
                  row_number() over (partition by target order by {h('row_id')}, row_id) - 1 as position
           from ({FX_EVENTS})),
c as (select distinct class, n from o), k as (select min(n) as k from c),
d as (select class, {h(f"'{SEED}'", "'balance'", 'class', 'slot')} % n as position
      from c, k, lateral (select unnest(range(k.k)) as slot) s)
select o.row_id, count(*) as n_draws from d join o on d.class = o.class and d.position = o.position
group by o.row_id""")
def balanced_sample(spark, folder):
    return sampling.balanced_sample(fx_events(spark, folder), "target", "row_id", seed=SEED)


@query("shuffled_rows", f"""
select row_id, target, row_number() over (order by {h(f"'{SEED}'", "'shuffle'", 'row_id')}, row_id) - 1 as position
from ({FX_EVENTS})""")
def shuffled_rows(spark, folder):
    return sampling.with_position(sampling.shuffled(fx_events(spark, folder).select("row_id", "target"), "row_id", SEED))


def _holdout_sql(n_folds: int, test_size: int) -> str:
    return f"""
select f.fold, case when v.subject is null then 'fit' else 'val' end as role, f.subject,
       coalesce(v.n, 1) as n_draws
from (select cast(fold as integer) as fold, subject from ({SUBJECTS}), range({n_folds}) f(fold)) f
left join (
  with o as (select target as class, subject, count(*) over (partition by target) as n,
                    row_number() over (partition by target order by {h('subject')}, subject) - 1 as position
             from ({SUBJECTS})),
  c as (select distinct class, n from o), k as (select least({test_size}, min(n)) as k from c),
  d as (select class, fold, {h(f"'{SEED}'", "'holdout'", 'class', 'fold', 'slot')} % n as position
        from c, k, range({n_folds}) f(fold), range({test_size}) s(slot) where slot < k.k)
  select d.fold, o.subject, count(*) as n from d join o on d.class = o.class and d.position = o.position
  group by d.fold, o.subject
) v on f.fold = v.fold and f.subject = v.subject
"""


HOLDOUT_SQL = _holdout_sql(5, TEST_SIZE)


@query("holdout_folds", HOLDOUT_SQL)
def holdout_folds_query(spark, folder):
    return holdout_folds(subjects_of_orders(spark, folder), "subject", "target", 5, TEST_SIZE, SEED)


@query("holdout_single", _holdout_sql(1, 1_000_000))
def holdout_single(spark, folder):
    return holdout_folds(subjects_of_orders(spark, folder), "subject", "target", 1, 1_000_000, SEED)


STRATA_SQL = f"""
select f.segment as fold, case when s.segment = f.segment then 'val' else 'fit' end as role, s.subject,
       cast(1 as bigint) as n_draws
from ({SUBJECTS}) s, (select distinct segment from ({SUBJECTS})) f
"""


@query("strata_folds", STRATA_SQL)
def strata_folds_query(spark, folder):
    return strata_folds(subjects_of_orders(spark, folder), "subject", "segment")


@query("stratum_held_out", f"select * from ({STRATA_SQL}) where fold = 'BUILDING'")
def stratum_held_out(spark, folder):
    return strata_folds(subjects_of_orders(spark, folder), "subject", "segment", values=["BUILDING"])


BALANCED_SQL = f"""
with sides as (select f.segment as fold, case when s.segment = f.segment then 'val' else 'fit' end as role,
                      s.subject, cast(s.target as varchar) as class
               from ({SUBJECTS}) s, (select distinct segment from ({SUBJECTS})) f),
o as (select *, count(*) over (partition by fold, role, class) as n,
             row_number() over (partition by fold, role, class order by {h('subject')}, subject) - 1 as position
      from sides),
c as (select distinct fold, role, class, n from o),
k as (select fold, role, min(n) as k from c group by fold, role having count(*) = 2),
d as (select c.fold, c.role, c.class,
             {h(f"'{SEED}'", "'balance'", 'c.fold', 'c.role', 'c.class', 'slot')} % c.n as position
      from c join k on c.fold = k.fold and c.role = k.role, lateral (select unnest(range(k.k)) as slot) s)
select o.fold, o.role, o.subject, count(*) as n_draws
from d join o on d.fold = o.fold and d.role = o.role and d.class = o.class and d.position = o.position
group by o.fold, o.role, o.subject
union all
select fold, role, subject, 1 from sides
where (fold, role) in (select (fold, role) from c group by fold, role having count(*) <> 2)
"""


@query("strata_folds_balanced", BALANCED_SQL)
def strata_folds_balanced(spark, folder):
    subjects = pin(subjects_of_orders(spark, folder))  # read for the strata, the sizes, the prefixes and the ranks
    return strata_folds(subjects, "subject", "segment", "target", seed=SEED)


# Inner split of the fit subjects of every stratum fold.
_INNER_SQL = f"""
select m.fold, m.subject, case when t.subject is null then 'train' else 'test' end as side,
       coalesce(t.n, 1) as n_draws
from (select fold, subject from ({STRATA_SQL}) where role = 'fit') m
left join (
  with p as (select f.fold, f.subject, s.target as class
             from ({STRATA_SQL}) f join ({SUBJECTS}) s on f.subject = s.subject where f.role = 'fit'),
  o as (select *, count(*) over (partition by fold, class) as n, count(*) over (partition by fold) as n_fold,
               row_number() over (partition by fold, class order by {h('subject')}, subject) - 1 as position
        from p),
  c as (select distinct fold, class, n, n_fold from o),
  k as (select fold, least(min(n), cast(ceil((1.0::double - 0.8::double) * max(n_fold)) as bigint)) as k
        from c group by fold),
  d as (select c.fold, c.class, {h(f"'{SEED}'", "'inner'", 'c.fold', 'c.class', 'slot')} % c.n as position
        from c join k on c.fold = k.fold, lateral (select unnest(range(k.k)) as slot) s)
  select o.fold, o.subject, count(*) as n
  from d join o on d.fold = o.fold and d.class = o.class and d.position = o.position group by o.fold, o.subject
) t on m.fold = t.fold and m.subject = t.subject
"""


def _inner(spark, folder):
    subjects = subjects_of_orders(spark, folder)
    fit = strata_folds(subjects, "subject", "segment").filter("role = 'fit'").select("fold", "subject", N_DRAWS)
    return ensemble.inner_split(fit, subjects.select("subject", F.col("target").alias("class")), "subject", 0.8, SEED)


@query("inner_split", _INNER_SQL)
def inner_split(spark, folder):
    return _inner(spark, folder)[0].drop("__outer")


@query("ensemble_batches", f"""
with m as ({_INNER_SQL}),
p as (select m.fold, m.side, m.subject, s.target as class, s.row_id, copy
      from m join ({FX_FRAMES}) s on m.subject = s.subject, lateral (select unnest(range(m.n_draws)) as copy) x),
o as (select *, count(*) over (partition by fold, side, class) as n,
             row_number() over (partition by fold, side, class order by {h('subject')}, subject, {h('row_id')}, row_id, copy) - 1 as position
      from p),
c as (select distinct fold, side, class, n from o),
d as (select fold, side, class, cast(batch as integer) as batch, slot,
             {h(f"'{SEED}'", "'batch'", 'fold', 'side', 'class', 'batch', 'slot')} % n as position
      from c, range(4) b(batch), range(100) s(slot) where (side = 'train' or slot < 25) and (side = 'train' or batch < 3))
select d.fold, d.side, d.batch, d.slot * 2 + d.class as slot, o.row_id
from d join o on d.fold = o.fold and d.side = o.side and d.class = o.class and d.position = o.position""")
def ensemble_batches(spark, folder):
    split, n_subjects = _inner(spark, folder)
    plan = ensemble.BatchPlan(0.8, 4, 3, 200, 50)
    return ensemble.draw_batches(
        fx_frames(spark, folder), pin(split), n_subjects, plan, "subject", "target", "row_id", SEED, bits=PREFIX_BITS
    )[0]


@query("attempts", f"""
with f as (select fold, count(*) as n from ({STRATA_SQL}) where role = 'fit' group by fold),
a as (select fold, n, attempt from f, range(200) a(attempt))
select fold, attempt,
       {h(f"'{SEED}'", "'attempt'", "'0'", 'fold', 'attempt', "'train'")} % n as train_batch,
       {h(f"'{SEED}'", "'attempt'", "'0'", 'fold', 'attempt', "'test'")} % n as test_batch,
       round(0.5::double + {h(f"'{SEED}'", "'attempt'", "'0'", 'fold', 'attempt', "'alpha'")}::double
             / 1152921504606846976::double * 1.5::double, 9) as alpha,
       3 + {h(f"'{SEED}'", "'attempt'", "'0'", 'fold', 'attempt', "'max_depth'")} % 6 as max_depth
from a""")
def attempts(spark, folder):
    subjects = subjects_of_orders(spark, folder)
    sizes = strata_folds(subjects, "subject", "segment").filter("role = 'fit'").groupBy("fold").count().collect()
    folds = small_table(
        spark, [(r["fold"], r["count"], r["count"]) for r in sizes],
        [("fold", "string"), ("n_train", "bigint"), ("n_test", "bigint")],
    )
    ridge = ensemble.NodeSpec("Ridge", 10, {"alpha": {"range": [0.5, 2.0]}})
    tree = ensemble.NodeSpec("tree", 10, {"max_depth": (3, 9)})
    real, whole = (ensemble.attempt_table(folds, spec, 0, 0, 200, SEED) for spec in (ridge, tree))
    whole = whole.select("fold", "attempt", F.col("params")["max_depth"].cast("bigint").alias("max_depth"))
    return real.join(whole, ["fold", "attempt"]).select(
        "fold", "attempt", "train_batch", "test_batch",
        F.round(F.col("params")["alpha"].cast("double"), 9).alias("alpha"), "max_depth",
    )
