"""Queries over the given tables, one or more per operator."""

from __future__ import annotations

import importlib
import pkgutil

from skyloom.plans import registry


def load_all():
    """Import every query module and return (queries, SQL twins)."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return registry.QUERIES, registry.ORACLES
