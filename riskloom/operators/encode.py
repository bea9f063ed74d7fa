"""Categorical encoding and re-typing of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.prefix import text_codes

MAX_ONE_HOT = 1_000
MISSING_TEXT = "nan"


def as_category(c: str) -> Column:
    """Text of a value; a missing value is a category of its own."""
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT))


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """Mapping (category, code), codes 0.. in text order (so "10" sorts before "2")."""
    return text_codes(df.select(as_category(column).alias("category")), "category")


def encode_labels(df: DataFrame, column: str, mapping: DataFrame, unknown: int = -1) -> DataFrame:
    """Replace a column by its codes; a plain equi-join, so a huge mapping is not forced on executors."""
    coded = df.withColumn("category", as_category(column)).join(mapping, "category", "left")
    return coded.withColumn(column, F.coalesce("code", F.lit(unknown))).drop("category", "code")


def ordinal_code(column: str, order: Sequence[str], unknown: int = -1) -> Column:
    expr = F.lit(unknown)
    text = F.col(column).cast("string")
    for i in reversed(range(len(order))):
        expr = F.when(text == order[i], i).otherwise(expr)
    return expr


def fit_one_hot(df: DataFrame, column: str, most: int = MAX_ONE_HOT) -> list[str]:
    """Sorted categories; fails beyond ``most``, as each becomes a column of the table."""
    rows = df.select(as_category(column).alias("c")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column!r} has more than {most} categories; raise ``most`` for as many columns")
    return sorted(r.c for r in rows)


def encode_one_hot(
    df: DataFrame, column: str, categories: Sequence[str], drop_first: bool = False
) -> DataFrame:
    kept = categories[1:] if drop_first else categories
    text = as_category(column)
    return df.withColumns({f"{column}_{c}": (text == c).cast("int") for c in kept}).drop(column)


def numeric_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Text columns in which every present value reads as a number."""
    text = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    if not text:
        return []
    row = df.agg(
        *[
            (
                (F.count(c) > 0) & (F.count(c) == F.count(F.col(c).try_cast("double")))
            ).alias(c)
            for c in text
        ]
    ).first()
    return [c for c in text if row[c]]


def retype_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = numeric_text_columns(df, columns)
    return df.withColumns({c: F.col(c).try_cast("double") for c in names})
