"""Queries by name, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.tables import Tables
from .oracle_views import VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, with_views(oracle) if oracle else None)
        return build

    return register


def _used(text: str) -> list[str]:
    """Views the text names, dependencies first."""
    found: list[str] = []

    def visit(body: str) -> None:
        for view, sql in VIEWS.items():
            if re.search(rf"\b{view}\b", body) and view not in found:
                visit(sql.replace(view, ""))
                if view not in found:
                    found.append(view)

    visit(text)
    return found


def with_views(text: str) -> str:
    """Prefix the common table expressions a statement uses.

    A statement may start with its own ``name AS (...), ... SELECT``, behind RECURSIVE if one of them is.
    """
    parts = [f"{view} AS ({VIEWS[view]})" for view in _used(text)]
    body = text.strip()
    if body.startswith("RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*parts, body.removeprefix("RECURSIVE ")])
    if re.match(r"(?i)(SELECT|WITH)\b", body):
        return (("WITH " + ",\n".join(parts) + "\n") if parts else "") + body
    return "WITH " + ",\n".join([*parts, body]) if parts else "WITH " + body
