"""Registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module of this package once; returns the catalogue."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from quern.plans import catalog

    return catalog
