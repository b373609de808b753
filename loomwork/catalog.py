"""All queries of the library with their DuckDB equivalents."""

from __future__ import annotations

import importlib

from loomwork import registry

MODULES = ("operators.telemetry", "operators.ngram", "operators.routing", "operators.retrieval", "operators.attention", "operators.sequence", "operators.numeric", "operators.corpus", "operators.placement", "streaming.state", "operators.gather", "operators.files")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"loomwork.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
