"""Registered queries over the provided tables."""

import importlib

from ondula.plans.registry import REGISTRY, Query

MODULES = ("tables", "joins", "aggregates", "windows", "scalars", "graphs", "spectra", "nonlinear", "matrices", "streams")


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"ondula.plans.{name}")
    return REGISTRY
