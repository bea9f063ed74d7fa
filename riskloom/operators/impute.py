"""Missing values: fit fill values once, apply as a projection; ordered fills take an order key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import fill_from_neighbour
from riskloom.operators.profile import value_counts
from riskloom.operators.quantiles import quantiles


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column; ties go to the smaller value, in the column's own order."""
    types = dict(df.dtypes)
    result: dict[str, object] = {c: None for c in columns}
    for kind in {types[c] for c in columns}:
        same = [c for c in columns if types[c] == kind]
        counts = value_counts(df.select(*same), same).withColumn("v", F.col("value").cast(kind))
        best = counts.groupBy("variable").agg(
            F.min(F.struct((-F.col("n")).alias("minus_n"), "v")).alias("top")
        )
        for row in best.collect():  # one row per column
            result[row.variable] = row.top.v
    return result


def fit_fills(
    df: DataFrame, strategies: Mapping[str, str], constants: Mapping[str, object] | None = None
) -> dict[str, object]:
    """Fill value per column for mean, median, mode and constant; ordered fills get their fallback."""
    constants = dict(constants or {})
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() not in ("string", "boolean")}
    fills: dict[str, object] = {}
    ordered = {c: ("median" if c in numeric else "mode") for c, s in strategies.items() if s in ("forward", "backward")}
    plain = {c: ordered.get(c, s) for c, s in strategies.items() if s != "none"}
    means = [c for c, s in plain.items() if s == "mean"]
    if means:
        fills |= df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict()
    medians = [c for c, s in plain.items() if s == "median"]
    fills |= {c: v[0] for c, v in quantiles(df, medians, [0.5]).items()}
    mode_columns = [c for c, s in plain.items() if s == "mode"]
    if mode_columns:
        for c, v in modes(df, mode_columns).items():
            fills[c] = v if v is not None else constants.get(c, 0.0 if c in numeric else "missing")
    for c, s in plain.items():
        if s == "constant":
            fills[c] = constants.get(c, 0.0 if c in numeric else "missing")
        elif s not in ("mean", "median", "mode"):
            raise ValueError(f"unknown fill strategy {s!r} for {c!r}")
    return fills


def apply_fills(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None}
    )


def fill_ordered(
    df: DataFrame, columns: Sequence[str], order: str, by: Sequence[str] = (), backward: bool = False,
    fallback: Mapping[str, object] | None = None,
) -> DataFrame:
    """Forward or backward fill along ``order``; what stays empty gets the fallback value."""
    filled = fill_from_neighbour(df, columns, order, by, backward)
    return apply_fills(filled, fallback) if fallback else filled


def missing_indicators(df: DataFrame, columns: Sequence[str], suffix: str = "_missing") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in columns})
