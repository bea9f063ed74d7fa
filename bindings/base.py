"""Registry of bound queries and helpers shared by the binding modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.cohort import COHORT_SQL, cohort

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where its result is fixed, the DuckDB text that must agree with it."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def with_cohort(body: str) -> str:
    """DuckDB text over the cohort view; further CTEs may follow as ``, x AS (...) SELECT``."""
    return f"WITH cohort AS ({COHORT_SQL}) {body}"


def r6(expression: str, alias: str) -> str:
    """Rounded double column; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {alias}"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.round(F.col(name).cast("double"), 6) + F.lit(0.0)).alias(name)
            if kind in ("double", "float") or kind.startswith("decimal")
            else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["ORACLES", "QUERIES", "cohort", "query", "r6", "rounded", "table", "with_cohort"]
