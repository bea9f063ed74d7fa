"""Principal and independent components: moments are aggregates, small matrices stay on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.profile import sample_kurtosis
from riskloom.session import cut_lineage


def _standardised(df: DataFrame, columns: Sequence[str], key: str | None) -> DataFrame:
    kept = df.select(*([key] if key else []), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    vectors = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(kept)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return scaler.fit(vectors).transform(vectors).drop("raw", *columns)


def principal_components(
    df: DataFrame, columns: Sequence[str], variance: float = 0.95
) -> tuple[DataFrame, DataFrame]:
    """Variance table (component, share, cumulative) and loadings (component, feature, loading).

    Rows with gaps are left out; components stop at the wanted variance; the largest loading of a
    component is positive.
    """
    rows = _standardised(df, columns, None)
    model = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(rows)
    shares = model.explainedVariance.toArray()
    loadings = model.pc.toArray()
    keep = int(np.searchsorted(np.cumsum(shares), variance - 1e-12) + 1)
    keep = min(keep, len(columns))
    signs = np.sign(loadings[np.argmax(np.abs(loadings), axis=0), np.arange(len(columns))])
    loadings = loadings * signs
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(i + 1, float(shares[i]), float(np.cumsum(shares)[i])) for i in range(keep)],
        "component int, share double, cumulative double",
    )
    long = spark.createDataFrame(
        [(i + 1, c, float(loadings[j, i])) for i in range(keep) for j, c in enumerate(columns)],
        "component int, feature string, loading double",
    )
    return table, long


@dataclass
class Projection:
    """A fitted linear projection: standardise, then weigh. New rows are projected without a fit; gaps give null."""

    columns: list[str]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # components x columns
    back: np.ndarray  # columns x components

    def transform(self, df: DataFrame, prefix: str = "c") -> DataFrame:
        """The rows with ``{prefix}1`` .. for every component."""
        x = [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.spread)]
        return df.withColumns({f"{prefix}{i + 1}": _weighed(x, row) for i, row in enumerate(self.weights)})

    def inverse_transform(self, df: DataFrame, prefix: str = "c", suffix: str = "_back") -> DataFrame:
        """The columns as the components describe them."""
        parts = [F.col(f"{prefix}{i + 1}") for i in range(len(self.weights))]
        return df.withColumns({
            f"{c}{suffix}": _weighed(parts, row) * F.lit(float(s)) + F.lit(float(m))
            for c, row, m, s in zip(self.columns, self.back, self.mean, self.spread)
        })


def _weighed(values: Sequence[Column], weights: np.ndarray) -> Column:
    parts = [v * F.lit(float(w)) for v, w in zip(values, weights)]
    return sum(parts[1:], parts[0])


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    kept = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    row = kept.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    if row[0] is None:
        raise ValueError("no row has all columns")
    return np.array([row[f"m_{c}"] for c in columns]), np.array([row[f"s_{c}"] or 1.0 for c in columns])


def fit_principal_projection(df: DataFrame, columns: Sequence[str], variance: float = 0.95) -> Projection:
    """Principal components up to the wanted variance, as a projection of any rows with these columns."""
    mean, spread = _moments(df, columns)
    table, long = principal_components(df, columns, variance)
    weights = np.zeros((table.count(), len(columns)))
    for r in long.collect():  # components x columns
        weights[r["component"] - 1, list(columns).index(r["feature"])] = r["loading"]
    return Projection(list(columns), mean, spread, weights, weights.T)


def fit_independent_projection(df: DataFrame, columns: Sequence[str], key: str, n_components: int | None = None, **settings) -> Projection:
    """Independent components as a projection of any rows with these columns."""
    mean, spread = _moments(df, columns)
    found = independent_components(df, columns, key, n_components, **settings)
    return Projection(list(columns), mean, spread, found["unmixing"], found["mixing"])


def loading_importance(loadings: DataFrame, components: int | None = None) -> DataFrame:
    """Square root of the summed squared loadings over the first components, per feature."""
    rows = loadings if components is None else loadings.filter(F.col("component") <= components)
    return rows.groupBy("feature").agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("importance"))


def _dot(vector: Column, weights: np.ndarray) -> Column:
    parts = [F.get(vector, i) * F.lit(float(w)) for i, w in enumerate(weights)]
    return sum(parts[1:], parts[0])


def independent_components(
    df: DataFrame, columns: Sequence[str], key: str, n_components: int | None = None, rounds: int = 100,
    tolerance: float = 1e-4, seed: int = 42,
) -> dict[str, object]:
    """FastICA (logcosh, all components together). One aggregation per round; p x p matrices on the driver.

    Returns sources per row, a component table (kurtosis, variance share), the unmixing and mixing
    matrices and the mean squared reconstruction error.
    """
    p = len(columns)
    k = n_components or p
    rows = _standardised(df, columns, key).select(key, vector_to_array("features").alias("x"))
    rows = cut_lineage(rows)
    second = rows.agg(
        F.count("*").alias("n"),
        *[F.avg(F.get("x", i) * F.get("x", j)).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)],
    ).first()
    cov = np.array([[second[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    whiten = (vectors[:, order] / np.sqrt(values[order])).T  # k x p
    z = rows.select(key, "x", F.array(*[_dot(F.col("x"), w) for w in whiten]).alias("z"))
    z = cut_lineage(z)

    def orthogonal(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return u @ np.diag(1.0 / np.sqrt(s)) @ u.T @ w

    w = orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
    steps = 0
    for steps in range(1, rounds + 1):
        projected = z.select("z", F.array(*[F.tanh(_dot(F.col("z"), row)) for row in w]).alias("g"))
        row = projected.agg(
            *[F.avg(F.get("g", i) * F.get("z", j)).alias(f"m{i}_{j}") for i in range(k) for j in range(k)],
            *[F.avg(1 - F.get("g", i) * F.get("g", i)).alias(f"d{i}") for i in range(k)],
        ).first()
        m = np.array([[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
        d = np.array([row[f"d{i}"] for i in range(k)])
        new = orthogonal(m - d[:, None] * w)
        change = float(np.max(np.abs(np.abs(np.sum(new * w, axis=1)) - 1)))
        w = new
        if change < tolerance:
            break
    unmixing = w @ whiten
    mixing = np.linalg.pinv(unmixing)
    sources = z.select(key, "x", *[_dot(F.col("x"), row).alias(f"ic{i + 1}") for i, row in enumerate(unmixing)])
    strength = (mixing**2).sum(axis=0)
    kurt = sources.agg(*[sample_kurtosis(f"ic{i + 1}").alias(f"ic{i + 1}") for i in range(k)]).first()
    table = df.sparkSession.createDataFrame(
        [
            (i + 1, float(kurt[f"ic{i + 1}"]), float(strength[i] / strength.sum()))
            for i in range(k)
        ],
        "component int, kurtosis double, variance_share double",
    )
    back = [
        F.get("x", j) - sum((F.col(f"ic{i + 1}") * float(mixing[j, i]) for i in range(k)), F.lit(0.0))
        for j in range(p)
    ]
    error = sources.select((sum((b * b for b in back), F.lit(0.0)) / p).alias("e")).agg(F.avg("e")).first()[0]
    return {
        "sources": sources.drop("x"), "components": table, "unmixing": unmixing, "mixing": mixing,
        "reconstruction_mse": float(error), "rounds": steps,
    }


def compare_components(df: DataFrame, columns: Sequence[str], key: str, n_components: int) -> DataFrame:
    """Reconstruction error and mean absolute kurtosis of as many principal and independent components."""
    rows = cut_lineage(_standardised(df, columns, key))
    model = PCA(k=n_components, inputCol="features", outputCol="pc").fit(rows)
    loadings = model.pc.toArray()
    scored = model.transform(rows).select(vector_to_array("features").alias("x"), vector_to_array("pc").alias("pc"))
    p = len(columns)
    back = [
        F.get("x", j) - sum((F.get("pc", i) * float(loadings[j, i]) for i in range(n_components)), F.lit(0.0))
        for j in range(p)
    ]
    pca = scored.select(
        (sum((b * b for b in back), F.lit(0.0)) / p).alias("e"),
        *[F.get("pc", i).alias(f"pc{i}") for i in range(n_components)],
    ).agg(
        F.avg("e").alias("mse"),
        *[F.abs(sample_kurtosis(f"pc{i}")).alias(f"k{i}") for i in range(n_components)],
    ).first()
    ica = independent_components(df, columns, key, n_components)
    kurtosis = ica["components"].agg(F.avg(F.abs("kurtosis"))).first()[0]
    return df.sparkSession.createDataFrame(
        [
            ("pca", float(pca.mse), float(np.mean([pca[f"k{i}"] for i in range(n_components)])), float(sum(model.explainedVariance.toArray()))),
            ("ica", ica["reconstruction_mse"], float(kurtosis), float(sum(model.explainedVariance.toArray()))),
        ],
        "method string, reconstruction_mse double, mean_abs_kurtosis double, variance_share double",
    )
