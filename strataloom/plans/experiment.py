"""Cross-validation experiments."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.config import StudySettings
from strataloom.materialize import BROADCAST_ROWS, pin
from strataloom.operators import metrics
from strataloom.operators.cells import fit_cells
from strataloom.operators.compress import SignalCompressor
from strataloom.operators.ensemble import Ensemble
from strataloom.operators.folds import holdout_folds, strata_folds
from strataloom.operators.sampling import resolve_variables
from strataloom.operators.subjects import (
    N_DRAWS,
    VARIES,
    hot_subjects,
    join_members,
    require_columns,
    roll_up_subjects,
)
from strataloom.operators.transform import encoder_chain, fit_stages, normalizer_chain

log = logging.getLogger(__name__)

ROWS = "n_rows"


class Experiment:
    """Runs encode → normalise → compress → fit → vote → score on every fold at once."""

    experiment_type = "EXPERIMENT"

    def __init__(self, signals: DataFrame, settings: StudySettings, row_id: str = "row_id", seed=0):
        s = settings
        self.settings, self.row_id, self.seed = settings, row_id, seed
        self.subject, self.target, self.score_target = s.subject.subject, s.subject.target, s.sampler.target
        require_columns(signals, [row_id, self.subject, self.target, self.score_target, *s.sampler.inputs])
        self.signals = signals
        self.inputs = resolve_variables(signals, self.score_target, s.sampler.inputs)
        self.ensemble = self.stats = self.predictions = None

    def subject_table(self, *extra: str) -> DataFrame:
        """Subjects with their info columns, always including the target and ``extra``.

        The same pass counts the rows of each subject and sees which columns vary within one.
        """
        watched = [c for c in dict.fromkeys([self.target, *extra]) if c]
        info = list(dict.fromkeys([*self.settings.subject.info, *watched]))
        subjects = pin(roll_up_subjects(self.signals, self.subject, info, watched, ROWS))
        flags = [f"{VARIES}{c}" for c in watched]
        varying = subjects.agg(*[F.count_if(F.col(f)).alias(f) for f in flags]).first()
        for column, flag in zip(watched, flags):
            if varying[flag]:
                log.warning("column %s varies within %d subjects; the maximum is used", column, varying[flag])
        return subjects.drop(*flags)

    def _chains(self):
        t = self.settings.transformer
        encoders = encoder_chain(t.encoders, t.encoder_params, t.encoder_columns, list(t.encoder_targets))
        scalers = normalizer_chain(t.normalizers, t.normalizer_params, t.normalizer_columns)
        compressor = SignalCompressor(t.clusters, t.cluster_columns, t.cluster_estimators) if t.clusters else None
        return encoders, scalers, compressor

    def _run(self, subjects: DataFrame, folds: DataFrame) -> DataFrame:
        """Fit and predict; leaves ``predictions`` with one row per fold and validation signal."""
        e = self.settings.ensemble
        self.folds = folds = pin(folds)
        fit_members = folds.filter("role = 'fit'").select("fold", self.subject, N_DRAWS)
        val_members = folds.filter("role = 'val'").select("fold", self.subject, N_DRAWS)
        # a small fold table is broadcast and signals stay in place; otherwise hot subjects are spread
        hot = None
        if folds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            fit_members, val_members = F.broadcast(fit_members), F.broadcast(val_members)
        else:
            hot = hot_subjects(subjects, self.subject, ROWS)
        fit_rows = join_members(self.signals, fit_members, self.subject, self.row_id, hot)
        encoders, scalers, compressor = self._chains()
        cells = None
        if encoders.steps or scalers.steps or compressor:
            cells = fit_cells(self.signals, folds, subjects, self.subject, self.row_id, ROWS)
        self.chain = fit_stages(fit_rows, ["fold"], N_DRAWS, encoders, scalers, compressor, cells)
        features = self.chain.features(self.inputs)
        self.ensemble = Ensemble(e.kinds, e.sizes, e.params).fit_folds(
            self.signals, fit_members, subjects.select(self.subject, self.target), self.subject, self.target,
            self.row_id, self.chain.transform, features, self.settings.sampler.plan, e.score_cap, e.get_best,
            self.seed,
        )
        # a target-encoded or scaled score target must not be scored in its changed form
        val_rows = join_members(self.signals, val_members, self.subject, self.row_id, hot).withColumn(
            "__truth", F.col(self.score_target).cast("int")
        )
        voted = self.ensemble.predict_proba(self.chain.transform(val_rows))
        scored = metrics.classify(voted, e.threshold).select(
            "fold", self.row_id, self.subject, F.col("__truth").alias("y"), N_DRAWS, "proba", "pred"
        )
        self.predictions = pin(scored)
        return self.predictions

    def report(self) -> DataFrame:
        """Mean of every score over the folds."""
        if self.stats is None:
            raise RuntimeError("the experiment has not run yet")
        return metrics.report(self.stats, [c for c in self.stats.columns if c != "fold"])


class HoldoutExperiment(Experiment):
    """Repeated random hold-out of subjects: accuracy, FNR, FPR, ROC AUC."""

    experiment_type = "CROSS_VALIDATION"

    def run(self, n_folds: int = 10, test_set_size: int = 10) -> DataFrame:
        subjects = self.subject_table()
        folds = holdout_folds(subjects, self.subject, self.target, n_folds, test_set_size, self.seed)
        scored = self._run(subjects, folds)
        self.stats = pin(
            metrics.fold_rates(scored, "y", N_DRAWS).join(metrics.fold_auc(scored, "y", N_DRAWS), "fold")
        )
        return self.stats


class LeaveStratumOutExperiment(Experiment):
    """One fold per stratum: accuracy, FNR, FPR; ``predictions`` holds the vote shares."""

    experiment_type = "LEAVE_ONE_OUT"

    def run(self, loo_variable: str) -> DataFrame:
        subjects = self.subject_table(loo_variable)
        scored = self._run(subjects, strata_folds(subjects, self.subject, loo_variable, seed=self.seed))
        self.stats = pin(metrics.fold_rates(scored, "y", N_DRAWS))
        return self.stats


class StratifiedExperiment(Experiment):
    """One fold per stratum, optionally balanced: also ROC AUC and the stratum's weight."""

    experiment_type = "STRATIFIED_CROSS_VALIDATION"

    def run(self, strata_variable: str, balanced_by: str | None = None) -> DataFrame:
        subjects = self.subject_table(strata_variable, balanced_by)
        folds = strata_folds(subjects, self.subject, strata_variable, balanced_by, seed=self.seed)
        scored = self._run(subjects, folds)
        members = self.folds.join(subjects.select(self.subject, ROWS), self.subject).withColumn(
            "__w", F.col(ROWS) * F.col(N_DRAWS)
        )
        self.stats = pin(
            metrics.fold_rates(scored, "y", N_DRAWS)
            .join(metrics.strata_auc(scored, "y", N_DRAWS), "fold")
            .join(metrics.strata_weight(members, "__w"), "fold")
        )
        return self.stats
