"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import QUERIES, Query

MODULES = ("data", "behaviour", "dashboard", "recall", "evaluation", "ranking", "operations", "streams")


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
    return QUERIES
