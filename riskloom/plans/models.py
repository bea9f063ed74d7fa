"""The model catalogue on Spark ML and this package's own estimators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_order
from riskloom.operators.prefix import has_whole_number
from riskloom.plans.boosting import BoostedTrees
from riskloom.plans.stages import CalibratedLogistic, NeighbourClassifier

# Parameter grids of the catalogue (a depth of 30 is Spark's greatest, 0 or -1 is no bound)
GRIDS = {
    "knn": {"k": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "logreg_calibrated": {"c": [0.01, 0.1, 1.0, 10.0]},
    "dtree_balanced": {"maxDepth": [3, 5, 7, 30], "minInstancesPerNode": [1, 5, 10]},
    "rf_balanced": {
        "numTrees": [100, 200, 300], "maxDepth": [5, 10, 15, 30], "minInstancesPerNode": [2, 5, 10],
        "featureSubsetStrategy": ["sqrt", "log2"],
    },
    "xgb": {"maxDepth": [3, 5, 7], "minChildWeight": [1.0, 3.0, 5.0], "gamma": [0.0, 0.1, 0.5]},
    "xgb_balanced": {
        "maxDepth": [3, 4, 5], "minChildWeight": [3.0, 5.0, 7.0], "gamma": [0.1, 0.5, 1.0],
        "scalePosWeight": [8.0, 10.0, 10.3, 12.0, 15.0], "regAlpha": [0.0, 0.1, 1.0], "regLambda": [1.0, 1.5, 2.0],
    },
    "lgbm": {"maxLeaves": [31, 63, 127], "maxDepth": [-1, 6, 10]},
}
# Grids of the entries without a counterpart
GRIDS |= {
    "logreg": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]},
    "dtree": {"maxDepth": [3, 5, 10], "minInstancesPerNode": [1, 5, 10]},
    "rf": {"numTrees": [20, 50, 100], "maxDepth": [5, 10], "minInstancesPerNode": [1, 5]},
    "gbt": {"maxIter": [20, 50], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
    "mlp": {"hidden": [[8], [16], [16, 8]], "stepSize": [0.03, 0.1]},
}
GRIDS["gbt_balanced"] = GRIDS["gbt"]

# Settings of the boosted entries (row sampling of lgbm is off there, as no frequency is set)
BOOSTED = {
    "xgb": {"maxIter": 200, "stepSize": 0.05, "subsample": 0.9, "colsample": 0.9, "maxDepth": 6},
    "xgb_balanced": {"maxIter": 200, "stepSize": 0.05, "subsample": 0.8, "colsample": 0.8, "maxDepth": 6},
    "lgbm": {
        "maxIter": 400, "stepSize": 0.03, "colsample": 0.9, "balanced": True, "maxLeaves": 31, "maxDepth": -1,
        "minRows": 20, "minChildWeight": 0.001, "regLambda": 0.0,
    },
}


def classifier(name: str, seed: int = 42, key: str = "key", **params) -> Estimator:
    """Catalogue entry by name; class weights of the ``*_balanced`` learners are the caller's (see ``default_balancing``)."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if name in BOOSTED:
        return BoostedTrees(**common, seed=seed, **(BOOSTED[name] | params))
    if name == "knn":
        return NeighbourClassifier(**common, keyCol=key, **params)
    if name == "logreg_calibrated":
        return CalibratedLogistic(**common, seed=seed, **params)
    kind = name.removesuffix("_balanced")
    if kind == "logreg":
        return LogisticRegression(**common, **({"maxIter": 50, "regParam": 0.01} | params))
    if kind == "dtree":
        return DecisionTreeClassifier(**common, seed=seed, **({"maxDepth": 5} | params))
    if kind == "rf":
        settings = {"numTrees": 20, "maxDepth": 5} | params
        return RandomForestClassifier(**common, seed=seed, **({"cacheNodeIds": keeps_nodes(settings)} | settings))
    if kind == "gbt":
        return GBTClassifier(**common, seed=seed, **({"maxIter": 10, "maxDepth": 3} | params))
    if name == "mlp":
        hidden = params.pop("hidden", [8])  # the first layer takes the width of the encoded features when it is fitted
        return MultilayerPerceptronClassifier(**common, seed=seed, layers=[1, *hidden, 2], **({"maxIter": 50} | params))
    raise ValueError(f"unknown model {name!r}")


def keeps_nodes(params: Mapping) -> bool:
    """Deep forests keep the node of every row in every tree: else each level walks all rows down all trees again."""
    return int(params.get("maxDepth", 5)) > 5


def default_balancing(name: str) -> str:
    """Learners that only differ in their class weights."""
    return "class_weight" if name in ("logreg_balanced", "dtree_balanced", "rf_balanced", "gbt_balanced") else "none"


def parameter_grid(name: str) -> list[dict[str, object]]:
    if name not in GRIDS:
        raise ValueError(f"no grid for {name!r}")
    grid = GRIDS[name]
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def sampled_grid(name: str, draws: int, seed: int = 42) -> list[dict[str, object]]:
    """``draws`` different grid points in a seeded order (all of them if the grid is smaller)."""
    import random

    points = parameter_grid(name)
    return random.Random(seed).sample(points, min(draws, len(points)))


def model_input(df: DataFrame, target: str, key: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Typed narrow table for the pipelines: key as long or text, doubles, text with ``missing``, label."""
    return df.filter(F.col(target).isNotNull()).select(
        F.col(key).cast("long" if has_whole_number(df, key) else "string").alias(key),
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in categorical],
        F.col(target).cast("double").alias("label"),
    )


def with_score(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, vector_to_array("probability")[1])


def predict(model: PipelineModel, df: DataFrame, name: str, threshold: float = 0.5) -> DataFrame:
    """Batch prediction: class, probability, model name. Stateless, so it also takes a stream."""
    scored = with_score(model.transform(df), "probability_1")
    return scored.withColumns(
        {"predicted": (F.col("probability_1") >= threshold).cast("int"), "model": F.lit(name)}
    )


def hashed_share(df: DataFrame, key: str, share: float, seed: int | str = 42) -> DataFrame:
    """Nested sub-sample: a row in a smaller share is also in every larger one."""
    return df.filter(hash_order(key, seed) < F.lit(int(share * (1 << 60))))
