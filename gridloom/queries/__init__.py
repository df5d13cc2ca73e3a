"""Registered queries by operator family."""

from __future__ import annotations

import importlib
import pkgutil

from gridloom import registry


def load():
    """Import every family once; return (queries, oracle)."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(registry.QUERIES), dict(registry.ORACLE)
