"""Collects the registered queries of all sections."""

from __future__ import annotations

import importlib

from rainshade.queries.base import ORACLES, QUERIES

SECTIONS = ("sources", "projections", "joins", "aggregates", "windows", "ordering", "scalars", "folds",
            "sampling", "statistics", "composites", "extensions")


def _load() -> None:
    for s in SECTIONS:
        importlib.import_module(f"rainshade.queries.{s}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
