"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from .. import plans
from .registry import QUERIES, SQL


def _load() -> None:
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name not in ("catalogue", "registry"):
            importlib.import_module(f"{plans.__name__}.{m.name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
