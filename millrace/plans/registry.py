"""All registered queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "leak_report"
FAMILIES = ["ledger", "boards", "text", "amounts", "labels", "scoring", "sampling", "logs"]


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"millrace.plans.{name}")
