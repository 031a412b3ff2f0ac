"""Queries over the shared tables. Importing this package fills the registry."""

import importlib
import pkgutil

from loomwright.plans.registry import all_queries, all_sql

for _module in pkgutil.iter_modules(__path__):
    if _module.name.endswith("_queries"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["all_queries", "all_sql"]
