"""Discretisation of numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bands import right_closed_bands
from riskloom.operators.quantiles import clean_double, quantiles

STRATEGIES = ("uniform", "quantile", "kmeans", "custom")


@dataclass(frozen=True)
class Bins:
    """Edges and labels of one column. Fitted bins are ``[a, b)`` with the last one closed."""

    column: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]
    right_closed: bool = False

    def label(self) -> Column:
        x = clean_double(F.col(self.column))
        if self.right_closed:
            return right_closed_bands(x, self.edges, self.labels, include_lowest=True)
        expr = F.when(x.isNull(), F.lit(None).cast("string"))
        for edge, label in zip(self.edges[1:-1], self.labels):
            expr = expr.when(x < F.lit(edge), label)
        return expr.otherwise(self.labels[-1])


def interval_labels(edges: Sequence[float]) -> tuple[str, ...]:
    """``[a, b]`` for the first bin and ``(a, b]`` for the others, two decimals."""
    return tuple(
        f"{'[' if i == 0 else '('}{low:.2f}, {high:.2f}]"
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    )


def fit_bins(
    df: DataFrame, column: str, strategy: str = "quantile", n_bins: int = 5,
    edges: Sequence[float] | None = None, labels: Sequence[str] | None = None, seed: int = 42,
) -> Bins:
    """Edges by equal width, equal counts, one-column k-means, or as given. Equal edges collapse."""
    value = clean_double(F.col(column))
    if strategy == "custom":
        if edges is None:
            raise ValueError("custom bins need edges")
        return Bins(
            column, tuple(edges), tuple(labels or (f"bin_{i}" for i in range(len(edges) - 1))), True
        )
    if strategy == "uniform":
        low, high = df.agg(F.min(value), F.max(value)).first()
        found = [low + (high - low) * i / n_bins for i in range(n_bins + 1)]
    elif strategy == "quantile":
        found = quantiles(df, {column: value}, [i / n_bins for i in range(n_bins + 1)])[column]
    elif strategy == "kmeans":
        low, high = df.agg(F.min(value), F.max(value)).first()
        rows = df.select(value.alias("x")).filter(F.col("x").isNotNull())
        counted = rows.groupBy("x").agg(F.count("*").cast("double").alias("w"))
        points = VectorAssembler(inputCols=["x"], outputCol="features").transform(counted)
        model = KMeans(k=n_bins, seed=seed, weightCol="w", maxIter=50).fit(points)
        centres = sorted(float(c[0]) for c in model.clusterCenters())
        found = [low, *[(a + b) / 2 for a, b in zip(centres, centres[1:])], high]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    distinct = tuple(sorted(set(found)))
    if len(distinct) == 1:
        distinct = (distinct[0], distinct[0])
    if labels is None or len(labels) != len(distinct) - 1:
        labels = interval_labels(distinct)
    return Bins(column, distinct, tuple(labels))


def apply_bins(df: DataFrame, bins: Mapping[str, Bins] | Sequence[Bins]) -> DataFrame:
    bins = bins.values() if isinstance(bins, Mapping) else bins
    return df.withColumns({b.column: b.label() for b in bins})


def bin_summary(df: DataFrame, bins: Bins) -> DataFrame:
    """Rows per label and the missing count, as (label, n)."""
    labelled = df.select(bins.label().alias("label"))
    return labelled.groupBy(F.coalesce("label", F.lit("missing")).alias("label")).agg(
        F.count("*").alias("n")
    )
