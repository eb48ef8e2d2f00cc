"""Queries over the benchmark tables, one per operator, and their SQL twins."""

from __future__ import annotations

import importlib

from casegate.catalog.registry import ORACLES, QUERIES, Query

_MODULES = ["intake", "placement", "reconciliation", "streams"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"casegate.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
