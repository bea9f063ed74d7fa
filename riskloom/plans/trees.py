"""Tree ensembles as plain arrays: scores and exact attributions of every row, worked out inside Spark tasks.

``ensemble_of`` reads the nodes of a fitted tree model (its own persisted node table for Spark ML models). An attribution
is the Shapley value of the game in which an unknown feature sends a row down both branches in proportion to the
training rows there (the path-dependent value). A leaf only involves the features on its path, so its share has a closed
form: with the rows' yes/no answers per feature and the branch shares, the sum over all subsets is a product polynomial.
Rows with the same answers share it, so a leaf costs one small table per batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import shared_folder


@dataclass
class Tree:
    """Node arrays; node 0 is the root and ``feature`` is -1 at a leaf. A row goes left when its value is at most the
    threshold, or is one of the node's categories; a missing value follows ``missing_left``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    missing_left: np.ndarray
    categories: dict[int, np.ndarray] = field(default_factory=dict)

    def to_left(self, node: int, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature[node]]
        left = np.isin(v, self.categories[node]) if node in self.categories else v <= self.threshold[node]
        return np.where(np.isnan(v), self.missing_left[node], left)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                left = self.to_left(node, x[rows])
                waiting += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return out

    def expected(self) -> float:
        leaves = self.feature < 0
        return float((self.value * self.cover)[leaves].sum() / self.cover[0])

    def attributions(self, x: np.ndarray, out: np.ndarray, weight: float) -> None:
        """Adds the tree's attributions (times ``weight``) to ``out`` (rows, features)."""
        # (node, per feature on the path: share of the rows that an unknown value follows, which rows follow it)
        waiting: list[tuple[int, dict[int, tuple[float, np.ndarray]]]] = [(0, {})]
        while waiting:
            node, path = waiting.pop()
            f = int(self.feature[node])
            if f < 0:
                if path and self.value[node]:
                    _leaf(path, float(self.value[node]) * weight, out)
                continue
            left = self.to_left(node, x)
            share, follows = path.get(f, (1.0, np.ones(len(x), bool)))
            for child, here in ((self.left[node], left), (self.right[node], ~left)):
                part = float(self.cover[child] / self.cover[node]) if self.cover[node] else 0.0
                waiting.append((child, path | {f: (share * part, follows & here)}))


def _leaf(path: Mapping[int, tuple[float, np.ndarray]], value: float, out: np.ndarray) -> None:
    features = list(path)
    d = len(features)
    answers = np.stack([path[f][1] for f in features], axis=1)
    shares = np.array([path[f][0] for f in features])
    code = answers @ (1 << np.arange(d)).astype(object) if d > 62 else answers @ (1 << np.arange(d))
    _, first, of_row = np.unique(code, return_index=True, return_inverse=True)
    yes = answers[first].astype(float)
    weights = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
    for j in range(d):
        product = np.ones((len(yes), 1))
        for k in range(d):
            if k != j:
                grown = np.zeros((len(yes), product.shape[1] + 1))
                grown[:, :-1] = product * shares[k]
                grown[:, 1:] += product * yes[:, [k]]
                product = grown
        out[:, features[j]] += (value * (yes[:, j] - shares[j]) * (product @ weights))[of_row]


@dataclass
class Ensemble:
    """bias + sum of weight * tree; ``scale`` says whether that is a probability or a margin (log-odds)."""

    trees: list[Tree]
    weights: list[float]
    bias: float = 0.0
    scale: str = "probability"

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * t.predict(x) for w, t in zip(self.weights, self.trees)), np.zeros(len(x)))

    def base(self) -> float:
        """The score of a row of which nothing is known."""
        return self.bias + sum(w * t.expected() for w, t in zip(self.weights, self.trees))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for w, t in zip(self.weights, self.trees):
            t.attributions(x, out, w)
        return out


def tree_from_nodes(nodes: Sequence[Mapping], classes: bool) -> Tree:
    """A tree from persisted Spark ML nodes (``id, prediction, impurityStats, leftChild, rightChild, split``)."""
    nodes = sorted(nodes, key=lambda n: n["id"])
    stats = [np.array(n["impurityStats"], float) for n in nodes]
    cover = np.array([s.sum() if classes else s[0] for s in stats])
    value = np.array([s[1] / s.sum() if classes else n["prediction"] for n, s in zip(nodes, stats)])
    split = [n["split"] for n in nodes]
    feature = np.array([s["featureIndex"] if n["leftChild"] >= 0 else -1 for n, s in zip(nodes, split)])
    cuts = [list(s["leftCategoriesOrThreshold"]) for s in split]
    named = {i: np.array(c) for i, (s, c) in enumerate(zip(split, cuts)) if feature[i] >= 0 and s["numCategories"] >= 0}
    threshold = np.array([c[0] if feature[i] >= 0 and i not in named else np.nan for i, c in enumerate(cuts)])
    left, right = (np.array([n[side] for n in nodes]) for side in ("leftChild", "rightChild"))
    return Tree(feature, threshold, left, right, value, cover, np.zeros(len(nodes), bool), named)


def ensemble_of(stage: Model, spark) -> Ensemble:
    """Trees of a fitted decision tree, forest, boosted trees or ``BoostedTreesModel`` (as large as the model)."""
    if hasattr(stage, "ensemble"):
        return stage.ensemble()
    folder = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    stage.write().save(folder)
    rows = spark.read.parquet(f"{folder}/data").collect()
    boosted, forest = "GBT" in type(stage).__name__, hasattr(stage, "treeWeights")
    classes = not boosted and hasattr(stage, "numClasses") and stage.numClasses == 2
    if not classes and not boosted and hasattr(stage, "numClasses"):
        raise ValueError("attributions need a model of two classes or a number")
    grouped: dict[int, list] = {}
    for r in rows:
        grouped.setdefault(r["treeID"] if forest else 0, []).append(r["nodeData"] if forest else r)
    trees = [tree_from_nodes([n.asDict(recursive=True) for n in grouped[i]], classes) for i in sorted(grouped)]
    if boosted:
        return Ensemble(trees, list(stage.treeWeights), 0.0, "margin")
    return Ensemble(trees, [1.0 / len(trees)] * len(trees), 0.0, "probability" if classes else "value")


def _as_matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, width))
    return np.array([[np.nan if c is None else c for c in v] if v is not None else [np.nan] * width for v in vectors], float)


def scores(ensemble: Ensemble, features: Column, width: int) -> Column:
    """The ensemble's score of an array of numbers."""

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(ensemble.score(_as_matrix(vectors, width)))

    return of(features)


def tree_attributions(
    df: DataFrame, ensemble: Ensemble, slots: Sequence[str], key: str, features: str | Column = "features"
) -> DataFrame:
    """(key, feature, attribution) for every row; with ``ensemble.base()`` a row's attributions add up to its score.

    ``slots`` names the source column of every place of the feature vector; the places of one column are summed.
    ``features`` is a vector column or a column expression of an array of numbers. A null vector counts as all missing.
    """
    column = vector_to_array(features) if isinstance(features, str) else features
    names = list(dict.fromkeys(slots))
    place = np.array([names.index(s) for s in slots])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            found = ensemble.attributions(_as_matrix(vectors, len(slots)))
            summed = np.zeros((len(found), len(names)))
            np.add.at(summed.T, place, found.T)
            yield pd.Series(list(summed))

    rows = df.select(F.col(key), F.posexplode(of(column)).alias("at", "attribution"))
    labels = F.array(*[F.lit(n) for n in names])
    return rows.select(F.col(key), F.element_at(labels, F.col("at") + 1).alias("feature"), "attribution")
