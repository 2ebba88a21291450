"""End-to-end runs and the named query catalogue."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalogue():
    """Import every ``queries_*`` module once and return (queries, oracles)."""
    from wattline.plans import catalogue

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return catalogue.QUERIES, catalogue.ORACLES
