"""Study settings: four maps, checked on load."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from strataloom.functions.estimators import ESTIMATORS
from strataloom.operators.ensemble import KINDS, BatchPlan
from strataloom.operators.transform import ENCODERS, NORMALIZERS, lookup


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _required(settings: dict, keys, what: str) -> None:
    missing = [k for k in keys if k not in settings]
    if missing:
        raise ValueError(f"missing keys in the {what} settings: {missing}")


# Required keys of the four settings maps.
SUBJECT_KEYS = ("subject_id_column", "subject_data_columns", "target_variable")
SAMPLER_KEYS = ("train_test_fraction", "input_variables", "target_variable", "n_train_batches",
                "train_batches_size", "n_test_batches", "test_batches_size")
ENSEMBLE_KEYS = ("classifier_list", "node_sizes", "kwargs_list", "score_cap", "get_best", "class_threshold")
TRANSFORMER_KEYS = ("Encoders", "Encoders_kwargs", "Encoders_input_columns", "Encoders_target_columns",
                    "Normalizers", "Normalizers_kwargs", "Normalizers_input_columns",
                    "Signal_compressor_clusters", "Signal_compressor_input_columns",
                    "Signal_compressor_apply_estimators")


@dataclass(frozen=True)
class SubjectSettings:
    subject: str
    info: tuple
    target: str


@dataclass(frozen=True)
class SamplerSettings:
    inputs: tuple
    target: str
    plan: BatchPlan


@dataclass(frozen=True)
class EnsembleSettings:
    kinds: tuple
    sizes: tuple
    params: tuple
    score_cap: float
    get_best: int | None
    threshold: float


@dataclass(frozen=True)
class TransformerSettings:
    encoders: tuple = ()
    encoder_params: tuple = ()
    encoder_columns: tuple = ()
    encoder_targets: tuple = ()
    normalizers: tuple = ()
    normalizer_params: tuple = ()
    normalizer_columns: tuple = ()
    clusters: tuple = ()
    cluster_columns: tuple = ()
    cluster_estimators: tuple = ()


@dataclass(frozen=True)
class StudySettings:
    subject: SubjectSettings
    sampler: SamplerSettings
    ensemble: EnsembleSettings
    transformer: TransformerSettings
    raw: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(subject: dict, sampler: dict, ensemble: dict, transformer: dict) -> StudySettings:
        """Check required keys and names, and copy everything."""
        _required(subject, SUBJECT_KEYS, "subject")
        _required(sampler, SAMPLER_KEYS, "sampler")
        _required(ensemble, ENSEMBLE_KEYS, "ensemble")
        _required(transformer, TRANSFORMER_KEYS, "transformer")
        lookup(dict.fromkeys(KINDS), ensemble["classifier_list"])
        lookup(ENCODERS, transformer["Encoders"])
        lookup(NORMALIZERS, transformer["Normalizers"])
        named = [e for e in transformer["Signal_compressor_apply_estimators"] if not callable(e)]
        lookup(ESTIMATORS, named)
        return StudySettings(
            SubjectSettings(subject["subject_id_column"], tuple(subject["subject_data_columns"]),
                            subject["target_variable"]),
            SamplerSettings(
                tuple(sampler["input_variables"]), sampler["target_variable"],
                BatchPlan(sampler["train_test_fraction"], sampler["n_train_batches"], sampler["n_test_batches"],
                          sampler["train_batches_size"], sampler["test_batches_size"]),
            ),
            EnsembleSettings(
                tuple(ensemble["classifier_list"]), tuple(ensemble["node_sizes"]),
                tuple(dict(k) for k in ensemble["kwargs_list"]), ensemble["score_cap"], ensemble["get_best"],
                ensemble["class_threshold"],
            ),
            TransformerSettings(
                tuple(transformer["Encoders"]), tuple(dict(k) for k in transformer["Encoders_kwargs"]),
                tuple(map(tuple, transformer["Encoders_input_columns"])),
                tuple(transformer["Encoders_target_columns"]),
                tuple(transformer["Normalizers"]), tuple(dict(k) for k in transformer["Normalizers_kwargs"]),
                tuple(map(tuple, transformer["Normalizers_input_columns"])),
                tuple(transformer["Signal_compressor_clusters"]),
                tuple(map(tuple, transformer["Signal_compressor_input_columns"])),
                tuple(transformer["Signal_compressor_apply_estimators"]),
            ),
            {"subject": subject, "sampler": sampler, "ensemble": ensemble, "transformer": transformer},
        )

    @staticmethod
    def load(subject_path: str, sampler_path: str, ensemble_path: str, transformer_path: str) -> StudySettings:
        return StudySettings.of(*map(load_json, (subject_path, sampler_path, ensemble_path, transformer_path)))
