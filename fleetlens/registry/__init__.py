"""All registered queries."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

MODULES = ["normal", "filters", "rollups", "joins", "catalog", "ranking", "hosts", "security", "plans", "change",
           "texts", "streams", "sources", "sections", "sets"]


def load() -> tuple[dict, dict]:
    """Import every query module and return the queries and their SQL by name."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
