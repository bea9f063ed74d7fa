"""Column facts and profiles: wide single-scan aggregates, then long (variable, stat, value) rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.quantiles import clean_double, quantiles

FEW_VALUES = 10
_SURE_MANY = 64  # sketch estimates above this are never <= FEW_VALUES distinct values


@dataclass(frozen=True)
class ColumnFacts:
    name: str
    dtype: str
    numeric_type: bool
    n_rows: int
    n_present: int
    n_distinct: int | None  # exact when small, None when surely more than a few dozen
    majority_share: float | None  # share of the most frequent value, if it reaches the asked threshold

    @property
    def is_numeric(self) -> bool:
        few = self.n_distinct is not None and self.n_distinct <= FEW_VALUES
        return self.numeric_type and not (few and self.n_present > 0)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def _short_hash(c: str) -> Column:
    """52-bit hash: the sketch keeps its values as doubles, which are exact up to 53 bits."""
    return F.shiftright(F.xxhash64(c), 12)


def column_facts(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.5
) -> list[ColumnFacts]:
    """Type, missing and majority facts of every column from two scans and no row shuffle.

    A value that fills a share s of a column covers an interval of length s of the hashed column's
    ranks, so it holds a quantile of any finer grid: a sketch finds the candidates for a share of
    ``threshold`` or more (the median alone above one half) and the second scan counts them exactly.
    """
    columns = list(columns or df.columns)
    threshold = max(threshold, 0.001)
    steps = 2 if threshold >= 0.5 else math.ceil(1.25 / threshold)
    grid = [i / steps for i in range(1, steps)]
    accuracy = max(1000, 20 * steps)
    first = df.agg(
        F.count("*").alias("n"),
        *[
            F.struct(
                F.count(c).alias("present"),
                F.approx_count_distinct(c, 0.02).alias("about"),
                F.percentile_approx(
                    F.when(F.col(c).isNotNull(), _short_hash(c)), grid, F.lit(accuracy)
                ).alias("middle"),
            ).alias(f"f{i}")
            for i, c in enumerate(columns)
        ],
    ).first()
    second = df.agg(
        *[
            F.struct(
                F.greatest(
                    F.lit(0),
                    F.lit(0),
                    *[
                        F.count_if(F.col(c).isNotNull() & (_short_hash(c) == F.lit(candidate)))
                        for candidate in sorted(set(first[f"f{i}"].middle or ()))
                    ],
                ).alias("hits"),
                (
                    F.size(F.collect_set(c))
                    if first[f"f{i}"].about <= _SURE_MANY
                    else F.lit(None).cast("int")
                ).alias("distinct"),
            ).alias(f"f{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    types = {f.name: f.dataType for f in df.schema.fields}
    facts = []
    for i, c in enumerate(columns):
        present = first[f"f{i}"].present
        share = second[f"f{i}"].hits / present if present else None
        facts.append(
            ColumnFacts(
                c, types[c].simpleString(), isinstance(types[c], T.NumericType), first.n, present,
                second[f"f{i}"].distinct,
                share if share is not None and (share > 0.5 or share >= threshold and threshold < 0.5) else None,
            )
        )
    return facts


def facts_table(df: DataFrame, facts: Sequence[ColumnFacts]) -> DataFrame:
    rows = [
        (f.name, f.dtype, "numeric" if f.is_numeric else "categorical", f.n_rows, f.n_rows - f.n_present)
        for f in facts
    ]
    return df.sparkSession.createDataFrame(
        rows, "variable string, dtype string, kind string, n long, n_missing long"
    )


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness (G1); null below three values or without spread."""
    n = F.count(c)
    g = F.nanvl(F.skewness(c), F.lit(None).cast("double"))
    return F.when(n > 2, g * F.sqrt(n * (n - 1.0)) / (n - 2))


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis (G2); null below four values or without spread."""
    n = F.count(c)
    g = F.nanvl(F.kurtosis(c), F.lit(None).cast("double"))
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g + 6.0))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (variable, stat, value): moments, quartiles, shape and missing counts."""
    cleaned = df.select(*[clean_double(F.col(c)).alias(c) for c in columns])
    quartiles = quantiles(cleaned, columns, [0.25, 0.5, 0.75])
    row = cleaned.agg(
        *[
            F.struct(
                F.count(c).cast("double").alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.lit(quartiles[c][0]).cast("double").alias("q25"),
                F.lit(quartiles[c][1]).cast("double").alias("median"),
                F.lit(quartiles[c][2]).cast("double").alias("q75"),
                sample_skewness(c).alias("skewness"),
                sample_kurtosis(c).alias("kurtosis"),
                (F.count("*") - F.count(c)).cast("double").alias("missing"),
                (100.0 * (F.count("*") - F.count(c)) / F.count("*")).alias("missing_pct"),
            ).alias(c)
            for c in columns
        ]
    )
    stats = [
        "count", "mean", "std", "min", "max", "q25", "median", "q75", "skewness", "kurtosis",
        "missing", "missing_pct",
    ]
    long = row.unpivot([], list(columns), "variable", "s").select("variable", "s.*")
    return long.unpivot(["variable"], stats, "stat", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (variable, value, n) over non-null values; combined on the map side first."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], list(columns), "variable", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count("*").alias("n"))
    )


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per variable: values present, categories, most frequent value (smallest on ties), its count."""
    counts = value_counts(df, columns)
    return (
        counts.groupBy("variable")
        .agg(
            F.sum("n").alias("count"),
            F.count("*").alias("n_categories"),
            F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value"))).alias("top"),
        )
        .select(
            "variable", "count", "n_categories", F.col("top.value").alias("mode"),
            (-F.col("top.minus_n")).alias("mode_count"),
        )
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, missing count and missing share of each column, from one scan."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    row = df.agg(
        *[
            F.struct(
                F.lit(types[c]).alias("dtype"),
                F.count("*").alias("n_rows"),
                (F.count("*") - F.count(c)).alias("n_missing"),
                F.coalesce(
                    F.try_divide((F.count("*") - F.count(c)).cast("double"), F.count("*")), F.lit(0.0)
                ).alias("missing_share"),
            ).alias(c)
            for c in columns
        ]
    )
    return row.unpivot([], columns, "variable", "s").select("variable", "s.*")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share per target value, null included."""
    counts = df.groupBy(F.col(target).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def data_audit(df: DataFrame, columns: Sequence[str] | None = None, top: int = 20) -> DataFrame:
    """Missing shares (largest first, ``top`` rows) with flags for empty, sparse, constant columns."""
    facts = column_facts(df, columns)
    rows = []
    for f in facts:
        share = (f.n_rows - f.n_present) / f.n_rows if f.n_rows else 0.0
        constant = f.n_distinct is not None and f.n_distinct <= 1
        rows.append((f.name, share, f.n_present == 0, share > 0.8, constant))
    table = df.sparkSession.createDataFrame(
        rows,
        "variable string, missing_share double, all_missing boolean, mostly_missing boolean, constant boolean",
    )
    return table.orderBy(F.desc("missing_share"), "variable").limit(top)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between minimum and maximum: index, edges, count."""
    value = clean_double(F.col(column))
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (high - low) / bins or 1.0
    index = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        df.filter(value.isNotNull())
        .groupBy(index.alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
            "n",
        )
    )


def box_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles and maximum per column."""
    five = quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0])
    return df.sparkSession.createDataFrame(
        [(c, *five[c]) for c in columns],
        "variable string, low double, q25 double, median double, q75 double, high double",
    )


def top_categories(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent values (ties: smaller value first)."""
    return value_counts(df, [column]).orderBy(F.desc("n"), "value").limit(top)
