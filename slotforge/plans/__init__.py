"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from slotforge.plans import registry


def load() -> tuple[dict[str, registry.Query], dict[str, str]]:
    """Every registered query, and the SQL of those that have one."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(registry.QUERIES), dict(registry.SQL)
