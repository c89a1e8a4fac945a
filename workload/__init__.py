"""Queries over the test tables, each with the SQL that gives the same rows."""

import importlib
import pkgutil


def load():
    """Import every query module and return the registered queries and SQL texts."""
    from workload.registry import ORACLE, QUERIES
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"workload.{m.name}")
    return QUERIES, ORACLE
