"""Regularised gradient boosting as a Spark ML estimator: histograms are summed by Spark, the driver only picks splits.

Features are cut into bins at their own approximate quantiles once, and the binned rows are written once. A step of a
tree is one pass: every task routes its rows through the tree so far and sums gradient and curvature per (node, feature,
bin) of the smaller children; the larger child is the parent minus its sibling. Sums are whole numbers (fixed point), so
the trees do not depend on how rows are partitioned. The driver sees at most nodes x features x bins sums per pass. Row
sampling follows a hash of the row number (as the rows were written) and the round. Margins are written again every few trees, so that a pass
evaluates only the trees since then and a lost executor repeats little.

A node is split at the largest gain ``T(GL)^2/(HL+l2) + T(GR)^2/(HR+l2) - T(G)^2/(H+l2)`` with T the soft threshold by
l1, if both children weigh enough and the gain reaches ``gamma``. Rows without a value go to the side that gains more.
Without a bound on the leaves all nodes of a level are split together; with one, the leaf of the largest gain is split
first (several candidates are measured in one pass, but taken in strict order of gain).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
    HasSeed,
    HasStepSize,
    HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans.trees import Ensemble, Tree, _as_matrix, scores
from riskloom.session import cut_lineage, drop_table

_FILE_ROWS = 1 << 16  # rows in a file of the binned table
_POINT = 1 << 24  # fixed point of gradient sums
_TOGETHER = 16  # leaves measured in one pass under a bound on the leaves
_FRESH = 20  # trees between two writings of the margins

_FLOATS = {
    "minChildWeight": ("least sum of curvature in a child", 1.0),
    "gamma": ("least gain of a split", 0.0),
    "regLambda": ("L2 penalty of leaf values", 1.0),
    "regAlpha": ("L1 penalty of leaf values", 0.0),
    "subsample": ("share of rows a tree sees", 1.0),
    "colsample": ("share of features a tree sees", 1.0),
    "scalePosWeight": ("weight of rows with label 1", 1.0),
    "baseScore": ("starting score (a probability, or a number for squares); nan: the mean of the labels", math.nan),
}
_INTS = {
    "maxDepth": ("greatest depth; 0 or less: no bound", 6),
    "maxLeaves": ("greatest number of leaves, split best first; 0: no bound", 0),
    "minRows": ("least number of rows in a child", 1),
    "maxBins": ("bins per feature", 256),
}


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    objective: Param[str] = Param(Params._dummy(), "objective", "logistic or squared", TypeConverters.toString)

    def _is_squared(self) -> bool:
        return self.getOrDefault("objective") == "squared"


class BoostedTrees(_Shared, Estimator, HasWeightCol, HasMaxIter, HasStepSize, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Labels 0 and 1 (``logistic``) or numbers (``squared``); missing feature values may be NaN."""

    balanced: Param[bool] = Param(Params._dummy(), "balanced", "weigh classes inversely to their size", TypeConverters.toBoolean)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(objective="logistic", balanced=False, maxIter=100, stepSize=0.1, seed=42, featuresCol="features", labelCol="label")
        self._setDefault(**{n: v for n, (_, v) in {**_FLOATS, **_INTS}.items()})
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        get = self.getOrDefault
        spark = dataset.sparkSession
        label = F.col(get("labelCol")).cast("double")
        weight = F.col(get("weightCol")).cast("double") if self.isDefined("weightCol") and get("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(get("featuresCol")).alias("x"), label.alias("y"), weight.alias("w")).filter("y IS NOT NULL")
        rows = written = cut_lineage(rows.withColumn("id", F.monotonically_increasing_id()), _FILE_ROWS)
        if not self._is_squared():
            weigh = F.when(F.col("y") > 0, F.lit(get("scalePosWeight"))).otherwise(F.lit(1.0))
            if get("balanced"):
                n = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.sum("w").alias("n")).collect()}
                each = {c: sum(n.values()) / (len(n) * v) if v else 1.0 for c, v in n.items()}
                weigh = weigh * F.when(F.col("y") > 0, F.lit(each.get(True, 1.0))).otherwise(F.lit(each.get(False, 1.0)))
            rows = rows.withColumn("w", F.col("w") * weigh)
        facts = rows.agg(F.max(F.size("x")).alias("width"), F.avg(F.col("y") * F.col("w")).alias("s"), F.avg("w").alias("w")).first()
        if facts["width"] is None:
            raise ValueError("boosting needs rows with a label")
        width, mean = facts["width"], facts["s"] / facts["w"] if facts["w"] else 0.0
        start = mean if math.isnan(get("baseScore")) else get("baseScore")
        bias = start if self._is_squared() else math.log(max(start, 1e-9) / max(1 - start, 1e-9))
        cuts = _cut_points(rows, width, get("maxBins"))
        rows = cut_lineage(rows.select("id", "y", "w", _binned(cuts)("x").alias("b"), F.lit(float(bias)).alias("m")), _FILE_ROWS)
        drop_table(written)
        rng = np.random.default_rng(get("seed"))
        trees: list[Tree] = []
        fresh: list[Tree] = []
        for turn in range(get("maxIter")):
            chosen = np.sort(rng.permutation(width)[: max(1, round(get("colsample") * width))])
            tree = _Grower(self, rows, cuts, fresh, chosen, turn).grow()
            fresh.append(tree)
            trees.append(tree)
            if len(fresh) == _FRESH and turn + 1 < get("maxIter"):
                rows, fresh, written = cut_lineage(rows.withColumn("m", _moved(fresh, width)("b", "m")), _FILE_ROWS), [], rows
                drop_table(written)
        drop_table(rows)
        real = [_with_values(t, cuts) for t in trees]
        state = {"bias": float(bias), "width": width, "trees": [{k: v.tolist() for k, v in vars(t).items() if k != "categories"} for t in real]}
        model = BoostedTreesModel()
        model._set(state=json.dumps(state))
        return self._copyValues(model)


class BoostedTreesModel(_Shared, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds margin, probability and class of every row (``squared``: the number); kept as one text parameter."""

    state: Param[str] = Param(Params._dummy(), "state", "trees and bias", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(objective="logistic", featuresCol="features", labelCol="label")

    def ensemble(self) -> Ensemble:
        state = json.loads(self.getOrDefault("state"))
        kinds = {"feature": int, "left": int, "right": int, "missing_left": bool}
        trees = [Tree(**{k: np.array(v, kinds.get(k, float)) for k, v in t.items()}) for t in state["trees"]]
        return Ensemble(trees, [1.0] * len(trees), state["bias"], "value" if self._is_squared() else "margin")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        width = json.loads(get("state"))["width"]
        margin = scores(self.ensemble(), vector_to_array(get("featuresCol")), width)
        if self._is_squared():
            return dataset.withColumn(get("predictionCol"), margin)
        raw = dataset.withColumn(get("rawPredictionCol"), margin)
        m = F.col(get("rawPredictionCol"))
        p = 1 / (1 + F.exp(-m))
        return raw.withColumns({
            get("probabilityCol"): array_to_vector(F.array(1 - p, p)),
            get("predictionCol"): (m > 0).cast("double"),
            get("rawPredictionCol"): array_to_vector(F.array(-m, m)),
        })


def _settings(cls: type) -> None:
    for table, convert in ((_FLOATS, TypeConverters.toFloat), (_INTS, TypeConverters.toInt)):
        for name, (text, _) in table.items():
            setattr(cls, name, Param(Params._dummy(), name, text, convert))


_settings(BoostedTrees)


def _cut_points(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Per feature at most ``bins`` - 1 of its own values; all of them where it has so few."""
    shares = F.expr(f"cast(split('{','.join(str(i / bins) for i in range(1, bins))}', ',') AS array<double>)")
    value = lambda j: F.when(~F.isnan(F.col("x")[j]), F.col("x")[j])
    few = F.slice(F.sort_array(F.collect_set("v")), 1, bins)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), value(j).alias("v")) for j in range(width)])).alias("s")).select("s.*")
    # at most ``bins`` distinct values per feature are kept as they are, more are cut at quantiles
    found = long.filter("v IS NOT NULL").groupBy("j").agg(
        F.percentile_approx("v", shares, F.lit(10 * bins)).alias("q"), F.approx_count_distinct("v", 0.01).alias("n")
    ).collect()
    out = [np.zeros(0)] * width
    small = [r["j"] for r in found if r["n"] <= 0.9 * bins]
    if small:
        for r in long.filter(F.col("v").isNotNull() & F.col("j").isin(small)).groupBy("j").agg(few.alias("q")).collect():
            out[r["j"]] = np.array(r["q"][:-1], float)
    for r in found:
        if r["j"] not in small:
            out[r["j"]] = np.unique(np.array(r["q"], float))
    return out


def _binned(cuts: list[np.ndarray]):
    """Pandas UDF: packed 16-bit bins of a row; 0 is missing, bin i + 1 holds values up to cut i."""

    @F.pandas_udf(T.BinaryType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = _as_matrix(vectors, len(cuts))
            out = np.zeros(x.shape, np.uint16)
            for j, c in enumerate(cuts):
                out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], "left") + 1)
            yield pd.Series([r.tobytes() for r in out])

    return of


def _bins_of(packed, width: int) -> np.ndarray:
    if isinstance(packed, pa.BinaryArray) and not packed.null_count:  # all rows lie one after another
        _, places, data = packed.buffers()
        ends = np.frombuffer(places, np.int32)[packed.offset : packed.offset + len(packed) + 1]
        return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint16).reshape(-1, width)
    return np.frombuffer(b"".join(packed.to_pylist() if isinstance(packed, pa.Array) else packed), np.uint16).reshape(-1, width)


def _by_bin(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Leaf node of every row; thresholds are bins here."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows := rows[tree.feature[at[rows]] >= 0]):  # a level further at a time
        node = at[rows]
        b = bins[rows, tree.feature[node]]
        left = np.where(b == 0, tree.missing_left[node], b <= tree.threshold[node])
        at[rows] = np.where(left, tree.left[node], tree.right[node])
    return at


def _add_up(total: np.ndarray, places: np.ndarray, values: np.ndarray | None) -> None:
    """Adds whole numbers (none: ones) to the places of a flat array of whole numbers, without rounding."""
    if values is None:
        total += np.bincount(places, minlength=len(total))
    elif len(values) and float(np.abs(values).max()) * len(values) < 2.0**53:
        total += np.bincount(places, values, len(total)).astype(np.int64)
    else:
        np.add.at(total, places, values)


def _moved(fresh: list[Tree], width: int):
    @F.pandas_udf(T.DoubleType())
    def of(packed: pd.Series, margin: pd.Series) -> pd.Series:
        bins, m = _bins_of(packed, width), margin.to_numpy().copy()
        for tree in fresh:
            m += tree.value[_by_bin(tree, bins)]
        return pd.Series(m)

    return of


def _drawn(ids: np.ndarray, turn: int, seed: int, share: float) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64 < share


class _Grower:
    """Grows one tree; thresholds stay bins until the model is finished."""

    def __init__(self, spec: BoostedTrees, rows: DataFrame, cuts: list[np.ndarray], fresh: list[Tree], chosen: np.ndarray, turn: int):
        self.get, self.rows, self.cuts, self.fresh, self.chosen, self.turn = spec.getOrDefault, rows, cuts, fresh, chosen, turn
        self.squared = spec._is_squared()
        self.nodes: list[list] = []  # feature, threshold, left, right, missing_left
        self.sums: list[np.ndarray] = []  # per node: (features, bins, [rows, gradient, curvature])
        self.depth: list[int] = []
        self.best: dict[int, tuple] = {}

    def _tree(self, splits: list[list]) -> Tree:
        columns = list(zip(*splits))
        arrays = [np.array(c) for c in columns]
        zero = np.zeros(len(splits))
        return Tree(arrays[0], arrays[1], arrays[2], arrays[3], zero, zero, arrays[4])

    def _measure(self, splits: list[list], wanted: list[int]) -> list[np.ndarray]:
        """Sums of the ``wanted`` nodes of a tree, over all rows that the round draws."""
        tree, fresh, chosen, turn, squared = self._tree(splits), self.fresh, self.chosen, self.turn, self.squared
        width, most = len(self.cuts), max(len(c) for c in self.cuts) + 2
        share, seed = self.get("subsample"), self.get("seed")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(chosen), len(wanted) * most), np.int64)
            place = np.full(len(tree.feature), -1)
            place[wanted] = np.arange(len(wanted))
            for batch in (b for b in batches if b.num_rows):
                ids, y, w, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
                bins = _bins_of(batch.column(3), width)
                at = place[_by_bin(tree, bins)]
                keep = at >= 0 if share >= 1 else (at >= 0) & _drawn(ids, turn, seed, share)
                y, w, m, bins, at = y[keep], w[keep], m[keep], bins[keep], at[keep]
                if not len(y):
                    continue
                for t in fresh:
                    m += t.value[_by_bin(t, bins)]
                p = m if squared else 1 / (1 + np.exp(-m))
                g, h = (np.rint(v * _POINT).astype(np.int64) for v in ((p - y) * w, w if squared else p * (1 - p) * w))
                for k, j in enumerate(chosen):
                    flat = at * most + bins[:, j]
                    for s, values in enumerate((None, g, h)):
                        _add_up(total[s, k], flat, values)
            total = np.moveaxis(total.reshape(3, len(chosen), len(wanted), most), (2, 1, 3, 0), (0, 1, 2, 3))
            i, k, b = np.nonzero(total[..., 0])
            found = total[i, k, b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.astype(np.int32)) for v in (i, k, b)] + [pa.array(found[:, s]) for s in range(3)], ["i", "k", "b", "n", "g", "h"]
            )

        parts = self.rows.select("id", "y", "w", "b", "m").mapInArrow(add, "i int, k int, b int, n long, g long, h long")
        out = np.zeros((len(wanted), len(chosen), most, 3))
        summed = parts.groupBy("i", "k", "b").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        i, k, b, n, g, h = (summed.column(c).to_numpy() for c in range(6))
        out[i, k, b] = np.stack([n, g / _POINT, h / _POINT], axis=1)
        return list(out)

    def _part(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        pulled = np.sign(g) * np.maximum(np.abs(g) - self.get("regAlpha"), 0)
        under = h + self.get("regLambda")
        return np.divide(pulled**2, under, out=np.zeros_like(under), where=under > 0)

    def _split(self, node: int) -> None:
        """Keeps the best split of a node, if any is allowed; ties go to the first feature, bin and missing to the left."""
        sums = self.sums[node]
        if sums.shape[1] == 1:  # totals only
            return
        whole = sums.sum(axis=1, keepdims=True)
        with_value = np.cumsum(sums[:, 1:-1], axis=1)
        sides = np.stack([with_value + sums[:, :1], with_value], axis=-2)  # (features, bins, missing left or right, 3)
        rest = whole[:, :, None] - sides
        gain = sum(self._part(s[..., 1], s[..., 2]) for s in (sides, rest)) - self._part(whole[..., 1], whole[..., 2])[:, :, None]
        for s in (sides, rest):
            gain[(s[..., 0] < max(1, self.get("minRows"))) | (s[..., 2] < self.get("minChildWeight"))] = -np.inf
        top = gain.max(initial=-np.inf)
        if top > 1e-9 and top >= self.get("gamma"):
            k, b, side = np.argwhere(gain >= top - 1e-12 * abs(top))[0]
            self.best[node] = (float(top), int(self.chosen[k]), int(b) + 1, side == 0, sides[k, b, side], rest[k, b, side])

    def _children(self, nodes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Sums of both children of each node under its best split: the smaller measured, the other by difference."""
        splits, wanted, smaller = [list(n) for n in self.nodes], [], []
        for node in nodes:
            _, feature, b, missing, left, right = self.best[node]
            splits[node] = [feature, b, len(splits), len(splits) + 1, missing]
            smaller.append(0 if left[0] <= right[0] else 1)
            wanted.append(len(splits) + smaller[-1])
            splits += [[-1, 0, -1, -1, False], [-1, 0, -1, -1, False]]
        out = {}
        for node, side, sums in zip(nodes, smaller, self._measure(splits, wanted)):
            other = self.sums[node] - sums
            out[node] = (sums, other) if side == 0 else (other, sums)
        return out

    def _is_last(self, node: int, leaves: int) -> bool:
        """The children of this split cannot be split again, so their totals are enough."""
        return 0 < self.get("maxDepth") <= self.depth[node] + 1 or 0 < self.get("maxLeaves") <= leaves + 1

    def _ends(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        _, _, _, _, left, right = self.best[node]
        return left[None, None], right[None, None]

    def _add(self, sums: np.ndarray, depth: int) -> int:
        self.nodes.append([-1, 0, -1, -1, False])
        self.sums.append(sums)
        self.depth.append(depth)
        self._split(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def grow(self) -> Tree:
        bound = self.get("maxLeaves")
        self._add(self._measure([[-1, 0, -1, -1, False]], [0])[0], 0)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        leaves = 1
        while self.best and (bound <= 0 or leaves < bound):
            order = sorted(self.best, key=lambda n: (-self.best[n][0], n))
            known |= {n: self._ends(n) for n in order if n not in known and self._is_last(n, leaves)}
            if order[0] not in known:
                # under a bound further leaves are measured ahead, but only the best one is split
                several = order if bound <= 0 else order[: min(_TOGETHER, bound - leaves)]
                known |= self._children([n for n in several if n not in known])
            for node in order if bound <= 0 else order[:1]:
                left, right = known.pop(node)
                _, feature, b, missing, _, _ = self.best.pop(node)
                a = self._add(left, self.depth[node] + 1)
                self.nodes[node] = [feature, b, a, self._add(right, self.depth[node] + 1), missing]
                self.sums[node] = self.sums[node][:1]  # totals are enough from now on
                leaves += 1
        tree = self._tree(self.nodes)
        total = np.array([s[0].sum(axis=0) for s in self.sums])
        pulled = np.sign(total[:, 1]) * np.maximum(np.abs(total[:, 1]) - self.get("regAlpha"), 0)
        under = total[:, 2] + self.get("regLambda")
        tree.value = -self.get("stepSize") * np.divide(pulled, under, out=np.zeros_like(under), where=under > 0)
        tree.cover = total[:, 0]
        return tree


def _with_values(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """Bins become the values they end at."""
    threshold = np.array([cuts[f][int(b) - 1] if f >= 0 else np.nan for f, b in zip(tree.feature, tree.threshold)])
    return Tree(tree.feature, threshold, tree.left, tree.right, tree.value, tree.cover, tree.missing_left)
