"""Queries: sources, subjects, class counts, joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.catalog.draws import HOLDOUT_SQL, SEED, TEST_SIZE
from strataloom.catalog.registry import FX_DOCS, FX_ORDERS, SUBJECTS, query
from strataloom.catalog.views import fx_docs, fx_orders, subjects_of_orders
from strataloom.materialize import ensure_checkpoint_dir
from strataloom.operators import subjects as ops
from strataloom.operators.folds import holdout_folds
from strataloom.operators.sampling import resolve_variables
from strataloom.sources.tables import read_signals


def scratch(spark, name: str) -> str:
    """A fresh folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("csv_signal_table", f"select * from ({FX_ORDERS})")
def csv_signal_table(spark, folder):
    signals = fx_orders(spark, folder)
    path = scratch(spark, "signals") + ".csv"
    signals.write.option("header", True).csv(path)
    return read_signals(spark, path, schema=signals.schema, row_id="row_id")


@query("input_variables", f"select row_id, subject, segment, priority, status, amount from ({FX_ORDERS})")
def input_variables(spark, folder):
    signals = fx_orders(spark, folder)
    return signals.select(*resolve_variables(signals, "target"))


@query("subject_rollup", f"""
select subject, max(segment) as segment, max(target) as target, max(amount) as amount
from ({FX_ORDERS}) group by subject""")
def subject_rollup(spark, folder):
    return ops.roll_up_subjects(fx_orders(spark, folder), "subject", ["segment", "target", "amount"])


@query("subject_rollup_all_columns", f"""
select subject, max(row_id) as row_id, max(lang) as lang, max(target) as target, max(n_chars) as n_chars
from ({FX_DOCS}) where subject is not null group by subject""")
def subject_rollup_all_columns(spark, folder):
    return ops.roll_up_subjects(fx_docs(spark, folder), "subject")


@query("varying_within_subject", f"""
select 'lang' as "column", count(*) filter (where n_lang > 1) as n_subjects from
  (select subject, count(distinct lang) as n_lang from ({FX_DOCS}) group by subject)
union all
select 'target', count(*) filter (where n_target > 1) from
  (select subject, count(distinct target) as n_target from ({FX_DOCS}) group by subject)""")
def varying_within_subject(spark, folder):
    return ops.varying_within_subject(fx_docs(spark, folder), "subject", ["lang", "target"])


@query("distinct_values", f"select distinct segment from ({FX_ORDERS})")
def distinct_values(spark, folder):
    return ops.distinct_values(fx_orders(spark, folder), "segment")


@query("class_counts", f"select segment, target, count(*) as n from ({FX_ORDERS}) group by segment, target")
def class_counts(spark, folder):
    return ops.class_counts(fx_orders(spark, folder), "target", ["segment"])


@query("minority_size", f"""
select segment, least(count(*) filter (where target = 0), count(*) filter (where target = 1)) as n_minority
from ({FX_ORDERS}) group by segment""")
def minority_size(spark, folder):
    return ops.minority_size(fx_orders(spark, folder), "target", ["segment"])


@query("class_filter", f"select row_id, subject from ({FX_ORDERS}) where target = 1")
def class_filter(spark, folder):
    return ops.class_filter(fx_orders(spark, folder), "target", 1).select("row_id", "subject")


@query("split_by_value", f"select subject, segment, segment = 'BUILDING' as matches from ({SUBJECTS})")
def split_by_value(spark, folder):
    subjects = subjects_of_orders(spark, folder)
    return ops.split_by_value(subjects, "segment", "BUILDING").select("subject", "segment", "matches")


def _folds(spark, folder):
    return holdout_folds(subjects_of_orders(spark, folder), "subject", "target", 5, TEST_SIZE, SEED)


def _hot(signals):
    """Subjects of more than eight signals, so that the join spreads many of them."""
    return ops.hot_subjects(ops.subject_sizes(signals, "subject"), "subject", task_rows=8)


@query("signals_of_drawn_subjects", f"""
with f as ({HOLDOUT_SQL})
select f.fold, f.subject, s.row_id, s.amount
from ({FX_ORDERS}) s right join f on s.subject = f.subject, range(f.n_draws) copies
where f.role = 'val'""")
def signals_of_drawn_subjects(spark, folder):
    val = _folds(spark, folder).filter("role = 'val'").select("fold", "subject", "n_draws")
    signals = fx_orders(spark, folder)
    joined = ops.signals_of_members(signals, val, "subject", "row_id", _hot(signals))
    return ops.expand_draws(joined).select("fold", "subject", "row_id", "amount")


@query("fold_signals", f"""
with f as ({HOLDOUT_SQL})
select f.fold, f.role, f.subject, f.n_draws, s.row_id from ({FX_ORDERS}) s join f on s.subject = f.subject""")
def fold_signals(spark, folder):
    signals = fx_orders(spark, folder).select("subject", "row_id")
    return ops.join_members(signals, _folds(spark, folder), "subject", "row_id", _hot(signals)).select(
        "fold", "role", "subject", "n_draws", "row_id"
    )


@query("subjects_not_held_out", f"""
select subject, segment, target from ({SUBJECTS}) s
where not exists (select 1 from ({HOLDOUT_SQL}) f where f.role = 'val' and f.subject = s.subject)""")
def subjects_not_held_out(spark, folder):
    held_out = _folds(spark, folder).filter(F.col("role") == "val")
    return ops.without_subjects(subjects_of_orders(spark, folder), held_out, "subject")
