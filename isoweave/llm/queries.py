"""The registered queries of this subpackage.

Each ``opN_*`` module has ``QUERIES`` (name to callable) and ``ORACLES`` (name to DuckDB SQL).
"""

from __future__ import annotations

import importlib
import pkgutil

import isoweave.llm as _package

_MODULES = [
    importlib.import_module(f"isoweave.llm.{m.name}")
    for m in pkgutil.iter_modules(_package.__path__)
    if m.name.startswith("op") and m.name[2:3].isdigit()
]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
