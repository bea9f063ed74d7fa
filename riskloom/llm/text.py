"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores before those that a table already has (in any case)."""
    held, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def guarded(*private: str) -> Callable:
    """Decorator of an operator over a table: input columns named like its private columns travel under other names.

    Without such a column the operator runs as it is. The result has the input's own names again.
    """

    def guard(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **settings) -> DataFrame:
            clash = [c for c in docs.columns if c.lower() in private]
            if not clash:
                return operator(docs, *args, **settings)
            other = dict(zip(clash, unused([*docs.columns, *private], *[f"own{c}" for c in clash])))
            out = operator(docs.withColumnsRenamed(other), *args, **settings)
            return out.withColumnsRenamed({new: old for old, new in other.items()})

        return run

    return guard
