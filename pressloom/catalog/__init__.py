"""Queries over the sample tables, one or more per operator, with SQL counterparts."""

import importlib
import pkgutil

from pressloom.catalog.registry import QUERIES, SQL


def load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


__all__ = ["QUERIES", "SQL", "load"]
