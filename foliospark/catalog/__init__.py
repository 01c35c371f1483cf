"""Queries over the test tables, each with its SQL twin."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> dict:
    """Import every query module and return the registry."""
    from foliospark.catalog.tables import REGISTRY

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
