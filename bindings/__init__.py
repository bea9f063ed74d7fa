"""Binds the operators to the test tables, each with its DuckDB check query."""

from importlib import import_module

MODULES = [
    "tables", "scores", "evaluation", "cleaning", "statistics", "inference", "neighbours", "resampling", "modelling",
]


def load():
    """All bound queries and check texts, in module order."""
    from bindings.base import ORACLES, QUERIES

    for module in MODULES:
        import_module(f"bindings.{module}")
    return QUERIES, ORACLES
