"""Column and row selection before analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import fixed_values as fv
from riskloom.operators.quantiles import quantiles


def features_of(df: DataFrame, target: str, ids: Sequence[str] = tuple(fv.ID_COLUMNS)) -> DataFrame:
    """All columns but the target and the row identifiers."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column")
    return df.drop(target, *[c for c in ids if c in df.columns])


def leakage_free_columns(
    df: DataFrame, deny: Sequence[str], min_numeric_share: float = 0.5
) -> list[str]:
    """Columns that are not denied, not ``*.1`` copies, and not mostly unreadable text.

    A text column stays when more than ``min_numeric_share`` of all rows read as numbers; one
    aggregation checks every text column.
    """
    denied = {d.lower() for d in deny}
    named = [
        f for f in df.schema.fields if f.name.lower() not in denied and not f.name.endswith(".1")
    ]
    text = [f.name for f in named if isinstance(f.dataType, T.StringType)]
    shares = {}
    if text:
        readable = [
            F.avg(F.col(f"`{c}`").try_cast("double").isNotNull().cast("double")).alias(c)
            for c in text
        ]
        shares = df.agg(*readable).first().asDict()
    return [f.name for f in named if f.name not in shares or (shares[f.name] or 0.0) > min_numeric_share]


def drop_leakage(df: DataFrame, deny: Sequence[str], min_numeric_share: float = 0.5) -> DataFrame:
    kept = leakage_free_columns(df, deny, min_numeric_share)
    return df.select(*[F.col(f"`{c}`") for c in kept])


def score_inputs(
    df: DataFrame, variables: Sequence[str], keys: DataFrame | None = None, key: str = "patient_id"
) -> DataFrame:
    """Configured score variables plus every Killip column, optionally for the given keys only."""
    names = [c for c in df.columns if c in variables or "killip" in c.lower()]
    if keys is not None:
        df = df.join(keys.select(key), key, "left_semi")
    return df.select(key, *[c for c in names if c != key])


def analysis_set(df: DataFrame, columns: Sequence[str], target: str, key: str) -> DataFrame:
    """Rows with a target; columns read as numbers, gaps filled with the exact median (0 if none)."""
    rows = df.filter(F.col(target).isNotNull()).select(
        key, target, *[F.col(c).cast("string").try_cast("double").alias(c) for c in columns]
    )
    medians = quantiles(rows, columns, [0.5])
    return rows.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(medians[c][0] if medians[c][0] is not None else 0.0))
            for c in columns
        }
    )
