"""Checks of keyword settings: what is not supported raises instead of being ignored."""

from __future__ import annotations

# Settings of the machine or of an iterative solver that change no result here.
MACHINE = ("copy", "n_jobs", "verbose")


def reject_unknown(owner: str, given, valid) -> None:
    unknown = sorted(set(given) - set(valid) - set(MACHINE))
    if unknown:
        raise ValueError(f"{owner}: unknown settings {unknown}; valid: {sorted(valid)}")


def only_default(owner: str, given: dict, defaults: dict) -> None:
    """Settings that exist with one value only."""
    reject_unknown(owner, given, defaults)
    for name, value in given.items():
        if name in defaults and value != defaults[name]:
            raise ValueError(f"{owner}: {name}={value!r} is not supported; only {defaults[name]!r}")
