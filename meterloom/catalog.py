"""Registry of the engine's named queries and their DuckDB twins."""

from __future__ import annotations

import importlib
import pkgutil

from meterloom import queries as _families
from meterloom.queries import base


def _load() -> None:
    for m in pkgutil.iter_modules(_families.__path__):
        importlib.import_module(f"{_families.__name__}.{m.name}")


def queries():
    """Name -> function of (session, folder of tables)."""
    _load()
    return dict(sorted(base.QUERIES.items()))


def oracle_sql():
    """Name -> DuckDB SQL with the same rows."""
    _load()
    return dict(sorted(base.SQL.items()))


def flagship(spark, sf_dir):
    """Per-house photovoltaic features of the dense fixture."""
    return queries()["f1_pv20s"](spark, sf_dir)
