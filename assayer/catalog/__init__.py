"""Every operator as a runnable query over the supplied tables."""

from __future__ import annotations

import importlib

from assayer.catalog import registry

MODULES = ("production", "qc", "attribution", "metrics", "structure", "models", "scoring", "bayes_time", "runs_io", "details")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"assayer.catalog.{module}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(registry.CHECKS)
