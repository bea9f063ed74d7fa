"""Spark ML estimators for the parts of a training pipeline that Spark ML lacks, with saving and loading.

``Preprocessor`` drops empty and constant columns, fills and standardises numbers, encodes categories and may keep the
more important half of the features. ``Balanced`` wraps a classifier and resamples or weighs the rows it is fitted on,
and only those. ``CalibratedLogistic`` and ``NeighbourClassifier`` complete the catalogue. All work inside ``Pipeline``
and ``CrossValidator``; what a model has learned is one text parameter, and a table where it needs rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasOutputCol,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
    HasSeed,
    HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.balance import with_class_weight
from riskloom.operators.impute import fit_fills
from riskloom.operators.knn import knn_join
from riskloom.operators.masked import knn_impute
from riskloom.operators.oversample import balance
from riskloom.plans.boosting import BoostedTrees, BoostedTreesModel
from riskloom.session import cut_lineage, drop_table

MISSING = "missing"
# Rows in a file of a table that learners read
FIT_ROWS = 1 << 16


def _param(name: str, text: str, convert) -> Param:
    return Param(Params._dummy(), name, text, convert)


class _HasState(Params):
    state: Param[str] = _param("state", "what was learned, as JSON", TypeConverters.toString)

    def learned(self) -> dict:
        return json.loads(self.getOrDefault("state"))


class _WithTable(MLWriter):
    """Parameters, and beside them the rows that the model keeps."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        if self.instance.rows is not None:
            self.instance.rows.write.parquet(f"{path}/rows")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        if model.learned().get("rows"):
            model.rows = self.sparkSession.read.parquet(f"{path}/rows")
        return model


class _KeepsRows(MLReadable, MLWritable):
    rows: DataFrame | None = None

    def write(self) -> MLWriter:
        return _WithTable(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def copy(self, extra=None):
        out = super().copy(extra)
        out.rows = self.rows
        return out


class _Columns(HasOutputCol, HasLabelCol, HasSeed):
    numeric: Param[list] = _param("numeric", "columns of numbers", TypeConverters.toListString)
    categorical: Param[list] = _param("categorical", "columns of categories", TypeConverters.toListString)
    keyCol: Param[str] = _param("keyCol", "row key (knn and iterative only)", TypeConverters.toString)
    imputer: Param[str] = _param("imputer", "simple (median), knn or iterative", TypeConverters.toString)
    neighbours: Param[int] = _param("neighbours", "neighbours of the knn imputer", TypeConverters.toInt)


class Preprocessor(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns from the rows it is fitted on: kept columns, fills, means and spreads, categories, chosen features.

    Numbers: ``simple`` exact medians; ``knn`` the mean of the nearest fitted rows that have the value; ``iterative``
    every column with gaps predicted from the others, ``rounds`` times, by boosted trees or by a linear model. Then
    (x - mean) / population deviation (a deviation of zero divides by one). Categories: a null is the level ``missing``;
    levels not seen in the fit give zeros. ``selection`` keeps the features whose forest importance reaches the median.
    A column without values or with a single one is dropped, unless it is told not to; without any column left the
    vector is empty. More than ``mostCategories`` levels of one column raise an error.
    """

    scale: Param[bool] = _param("scale", "standardise numbers", TypeConverters.toBoolean)
    dropMissing: Param[bool] = _param("dropMissing", "drop columns without values", TypeConverters.toBoolean)
    dropConstant: Param[bool] = _param("dropConstant", "drop columns with one value", TypeConverters.toBoolean)
    rounds: Param[int] = _param("rounds", "rounds of the iterative imputer", TypeConverters.toInt)
    learner: Param[str] = _param("learner", "trees or linear, for the iterative imputer", TypeConverters.toString)
    trees: Param[int] = _param("trees", "trees per column and round of the iterative imputer", TypeConverters.toInt)
    selection: Param[bool] = _param("selection", "keep features of at least median importance", TypeConverters.toBoolean)
    selectionTrees: Param[int] = _param("selectionTrees", "trees of the selecting forest", TypeConverters.toInt)
    mostCategories: Param[int] = _param("mostCategories", "levels a column may have", TypeConverters.toInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(
            numeric=[], categorical=[], outputCol="features", labelCol="label", imputer="simple", neighbours=5, scale=True, dropMissing=True,
            dropConstant=True, rounds=10, learner="trees", trees=20, selection=False, selectionTrees=200, mostCategories=1000, seed=42,
        )
        self._set(**params)

    def _kept(self, df: DataFrame) -> tuple[list[str], list[str]]:
        get = self.getOrDefault
        wanted = [*get("numeric"), *get("categorical")]
        out = set()
        # one scan: a column is constant if its least value is its greatest
        facts = df.agg(*[F.struct(F.count(c).alias("n"), (F.min(c) == F.max(c)).alias("one")).alias(f"f{i}") for i, c in enumerate(wanted)]).first() if wanted else ()
        for c, f in zip(wanted, facts):
            if f.n == 0:
                out |= {c} if get("dropMissing") else set()
            elif get("dropConstant") and f.one:
                out.add(c)
        return [c for c in get("numeric") if c not in out], [c for c in get("categorical") if c not in out]

    def _fit(self, dataset: DataFrame) -> PreprocessorModel:
        get = self.getOrDefault
        mode = get("imputer")
        if mode not in ("simple", "knn", "iterative"):
            raise ValueError(f"unknown imputer {mode!r}")
        numeric, categorical = self._kept(dataset)
        numbers = dataset.select(*[F.col(c).cast("double").alias(c) for c in numeric])
        fills = {c: (0.0 if v is None else float(v)) for c, v in fit_fills(numbers, {c: "median" for c in numeric}).items()}
        state = {"numeric": numeric, "categorical": categorical, "fills": fills, "mode": mode, "scale": get("scale"), "rows": False, "chain": []}
        model = PreprocessorModel()
        self._copyValues(model)
        if mode == "knn" and numeric:
            model.rows = cut_lineage(dataset.select(get("keyCol"), *[F.col(c).cast("double").alias(c) for c in numeric]))
            state["rows"] = True
        elif mode == "iterative" and numeric:
            state["chain"] = self._chain(dataset, numeric, fills)
        state |= {"levels": self._levels(dataset, categorical), "mean": {c: 0.0 for c in numeric}, "spread": {c: 1.0 for c in numeric}}
        model._set(state=json.dumps(state))
        if get("scale") and numeric:
            filled = cut_lineage(model.filled(dataset)) if mode != "simple" else model.filled(dataset)
            facts = filled.agg(*[F.avg(f"{c}_filled").alias(f"m_{c}") for c in numeric], *[F.stddev_pop(f"{c}_filled").alias(f"s_{c}") for c in numeric]).first()
            state["mean"] = {c: facts[f"m_{c}"] or 0.0 for c in numeric}
            state["spread"] = {c: facts[f"s_{c}"] or 1.0 for c in numeric}
        state["slots"] = [*numeric, *[c for c in categorical for _ in state["levels"][c]]]
        model._set(state=json.dumps(state))
        if get("selection") and state["slots"]:
            x = cut_lineage(model.transform(dataset).select(get("outputCol"), F.col(get("labelCol")).cast("double").alias("label")))
            forest = RandomForestClassifier(featuresCol=get("outputCol"), labelCol="label", numTrees=get("selectionTrees"), seed=get("seed"))
            share = forest.fit(x).featureImportances.toArray()
            state["chosen"] = [int(i) for i in np.flatnonzero(share >= np.median(share))]
            state["slots"] = [state["slots"][i] for i in state["chosen"]]
            model._set(state=json.dumps(state))
        return model

    def _levels(self, df: DataFrame, categorical: Sequence[str]) -> dict[str, list[str]]:
        """Sorted levels per column, all columns in one pass."""
        if not categorical:
            return {}
        text = [F.struct(F.lit(c).alias("c"), _level(c).alias("v")) for c in categorical]
        most = self.getOrDefault("mostCategories")
        rows = df.select(F.explode(F.array(*text)).alias("s")).select("s.*").distinct().limit(most * len(categorical) + 1).collect()
        out = {c: sorted(r["v"] for r in rows if r["c"] == c) for c in categorical}
        many = [c for c, v in out.items() if len(v) > most]
        if many or len(rows) > most * len(categorical):
            raise ValueError(f"more than {most} levels in {many or categorical}: raise mostCategories or encode these columns otherwise")
        return out

    def _chain(self, df: DataFrame, numeric: list[str], fills: dict[str, float]) -> list[dict]:
        """One fitted step per column with gaps and round; a transform repeats the steps in order."""
        get = self.getOrDefault
        gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first().asDict()
        order = sorted((c for c in numeric if gaps[c]), key=lambda c: (gaps[c], c))
        known = [F.col(c).isNotNull().alias(f"k_{c}") for c in numeric]
        table = cut_lineage(df.select(*known, *[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in numeric]))
        chain: list[dict] = []
        for _ in range(get("rounds") if len(numeric) > 1 else 0):
            for c in order:
                step = _learn(table.filter(f"k_{c}"), c, [o for o in numeric if o != c], get("learner"), get("trees"), get("seed"))
                chain.append(step)
                table = table.withColumn(c, F.when(F.col(f"k_{c}"), F.col(c)).otherwise(_predicted(step)))
            table = cut_lineage(table)
        return chain


def _level(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def _learn(rows: DataFrame, target: str, others: list[str], learner: str, trees: int, seed: int) -> dict:
    x = rows.select(F.array(*others).alias("x"), F.col(target).alias("y"))
    if learner == "trees":
        vectors = x.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
        model = BoostedTrees(objective="squared", maxIter=trees, maxDepth=0, maxLeaves=31, minRows=20, minChildWeight=0.0, regLambda=0.0, stepSize=0.1, seed=seed).fit(vectors)
        return {"target": target, "others": others, "trees": model.getOrDefault("state")}
    if learner != "linear":
        raise ValueError(f"unknown learner {learner!r}")
    # least squares through the moments: one row of sums, whatever the number of rows
    names = [*others, target]
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)],
        *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j],
    ).first()
    k = len(others)
    cov = np.array([[sums[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    weights = np.linalg.lstsq(cov[:k, :k], cov[:k, k], rcond=None)[0]
    means = [sums[f"m_{i}"] or 0.0 for i in range(k + 1)]
    return {"target": target, "others": others, "weights": weights.tolist(), "bias": float(means[k] - weights @ np.array(means[:k]))}


def _predicted(step: dict) -> Column:
    if "trees" in step:
        from riskloom.plans.trees import scores

        model = BoostedTreesModel()
        model._set(state=step["trees"], objective="squared")
        return scores(model.ensemble(), F.array(*step["others"]), len(step["others"]))
    total = F.lit(step["bias"])
    for name, w in zip(step["others"], step["weights"]):
        total = total + F.lit(w) * F.col(name)
    return total


class PreprocessorModel(_KeepsRows, _Columns, _HasState, Model):
    """Adds the feature vector; ``slots()`` names the source column of each of its places."""

    def __init__(self):
        super().__init__()
        self._setDefault(outputCol="features", labelCol="label", neighbours=5)

    def slots(self) -> list[str]:
        return self.learned()["slots"]

    def filled(self, df: DataFrame) -> DataFrame:
        """The rows with ``{column}_filled`` for every number kept."""
        state, key = self.learned(), self.getOrDefault("keyCol") if self.isDefined("keyCol") else None
        numeric, fills = state["numeric"], state["fills"]
        numbers = [F.col(c).cast("double").alias(c) for c in numeric]
        if state["mode"] == "simple" or not numeric:
            return df.withColumns({f"{c}_filled": F.coalesce(n, F.lit(fills[c])) for c, n in zip(numeric, numbers)})
        if state["mode"] == "knn":
            done = knn_impute(df.select(key, *numbers), key, numeric, self.getOrDefault("neighbours"), self.rows)
        else:
            gaps = [F.col(c).isNotNull().alias(f"k_{c}") for c in numeric]
            done = df.select(key, *gaps, *[F.coalesce(n, F.lit(fills[c])).alias(c) for c, n in zip(numeric, numbers)])
            for step in state["chain"]:
                c = step["target"]
                done = done.withColumn(c, F.when(F.col(f"k_{c}"), F.col(c)).otherwise(_predicted(step)))
        return df.join(done.select(key, *[F.col(c).alias(f"{c}_filled") for c in numeric]), key)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.learned()
        parts = [
            F.array(*[(F.col(f"{c}_filled") - F.lit(state["mean"][c])) / F.lit(state["spread"][c]) for c in state["numeric"]]).cast("array<double>")
        ]
        for c in state["categorical"]:
            value = _level(c)
            parts.append(F.array(*[(value == F.lit(v)).cast("double") for v in state["levels"][c]]))
        whole = F.concat(*parts)
        if "chosen" in state:
            whole = F.transform(F.array(*[F.lit(i + 1) for i in state["chosen"]]), lambda i: F.element_at(whole, i)) if state["chosen"] else whole
        out = self.filled(dataset).withColumn(self.getOrDefault("outputCol"), array_to_vector(whole))
        return out.drop(*[f"{c}_filled" for c in state["numeric"]])


class _EstimatorWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.inner.write().save(f"{path}/estimator")


class _EstimatorReader(MLReader):
    def load(self, path: str) -> Balanced:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = Balanced(DefaultParamsReader.loadParamsInstance(f"{path}/estimator", self.sparkSession))
        out._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(out, found)
        return out


class Balanced(HasFeaturesCol, HasLabelCol, HasSeed, Estimator, MLReadable, MLWritable):
    """A classifier fitted on balanced rows. The result is the classifier's own model: new rows are never resampled.

    ``strategy``: none, class_weight, or any of ``oversample.balance``; neighbours are sought among the feature vectors,
    that is after filling and scaling, so no column's unit decides. Parameters of the classifier can be searched.
    """

    strategy: Param[str] = _param("strategy", "how the fitted rows are balanced", TypeConverters.toString)
    keyCol: Param[str] = _param("keyCol", "row key", TypeConverters.toString)

    def __init__(self, inner: Estimator | None = None, **params):
        super().__init__()
        self._setDefault(strategy="none", featuresCol="features", labelCol="label", seed=42, keyCol="key")
        self._set(**params)
        self.inner = inner

    def copy(self, extra=None) -> Balanced:
        extra = extra or {}
        out = super().copy({p: v for p, v in extra.items() if self.hasParam(p.name) and p.parent == self.uid})
        out.inner = self.inner.copy({p: v for p, v in extra.items() if p.parent == self.inner.uid})
        return out

    def write(self) -> MLWriter:
        return _EstimatorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EstimatorReader()

    def resampled(self, dataset: DataFrame) -> DataFrame:
        """The rows that the classifier is fitted on; with ``weight`` under class_weight."""
        get = self.getOrDefault
        strategy, label, features, key = get("strategy"), get("labelCol"), get("featuresCol"), get("keyCol")
        if strategy == "none":
            return dataset
        if strategy == "class_weight":
            return with_class_weight(dataset.drop("weight"), label)
        rows = cut_lineage(dataset.select(key, label, vector_to_array(features).alias("x")))
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
        names = [f"x{i}" for i in range(width)]
        wide = rows.select(key, label, *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
        even = balance(wide, strategy, label, key, names, get("seed"))
        return cut_lineage(even.select(key, label, array_to_vector(F.array(*names)).alias(features)))

    def _fit(self, dataset: DataFrame) -> Model:
        rows, inner = self.resampled(dataset), self.inner
        if self.getOrDefault("strategy") == "class_weight":
            if not inner.hasParam("weightCol"):
                raise ValueError(f"{type(inner).__name__} takes no weights")
            inner = inner.copy({inner.getParam("weightCol"): "weight"})
        if isinstance(inner, MultilayerPerceptronClassifier):  # its first layer is as wide as the encoded features
            width = rows.select(F.size(vector_to_array(self.getOrDefault("featuresCol")))).first()[0]
            inner = inner.copy({inner.layers: [width, *inner.getLayers()[1:]]})
        return inner.fit(rows)


class _Scores(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    """Columns that a classifier of two classes adds from the probability of class 1."""

    def _with(self, df: DataFrame, p: Column) -> DataFrame:
        get = self.getOrDefault
        scored = df.withColumn(get("predictionCol"), p)
        p = F.col(get("predictionCol"))
        pair = array_to_vector(F.array(1 - p, p))
        return scored.withColumns({get("rawPredictionCol"): pair, get("probabilityCol"): pair, get("predictionCol"): (p > 0.5).cast("double")})


class CalibratedLogistic(_Scores, HasWeightCol, HasSeed, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression with balanced classes, calibrated by a sigmoid on held-out folds; folds are averaged.

    ``c`` is the inverse penalty of the summed loss. Folds follow the hash of the row's features, so equal rows share one.
    """

    c: Param[float] = _param("c", "inverse penalty", TypeConverters.toFloat)
    folds: Param[int] = _param("folds", "calibration folds", TypeConverters.toInt)
    balancedClasses: Param[bool] = _param("balancedClasses", "weigh classes inversely to their size", TypeConverters.toBoolean)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(c=1.0, folds=2, balancedClasses=True, seed=42, featuresCol="features", labelCol="label")
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> CalibratedLogisticModel:
        get = self.getOrDefault
        label, k = get("labelCol"), get("folds")
        x = F.col(get("featuresCol"))
        weight = F.col(get("weightCol")).cast("double") if self.isDefined("weightCol") and get("weightCol") else F.lit(1.0)
        place = F.pmod(F.xxhash64(vector_to_array(x), F.lit(get("seed"))), F.lit(k)).cast("int")
        rows = cut_lineage(dataset.select(x.alias("features"), F.col(label).cast("double").alias("label"), weight.alias("given"), place.alias("fold")), FIT_ROWS)
        parts = []
        for f in range(k):
            train, held = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
            if get("balancedClasses"):
                train = with_class_weight(train, "label").withColumn("weight", F.col("weight") * F.col("given"))
            else:
                train = train.withColumn("weight", F.col("given"))
            total = train.agg(F.sum("weight")).first()[0]
            base = LogisticRegression(regParam=1.0 / (get("c") * (total or 1.0)), maxIter=500, tol=1e-3, weightCol="weight").fit(train)
            margin = base.transform(held).select("label", "given", F.slice(vector_to_array("rawPrediction"), 2, 1).alias("m"))
            sigmoid = LogisticRegression(featuresCol="v", weightCol="given", maxIter=100).fit(margin.select("label", "given", array_to_vector("m").alias("v")))
            parts.append([base.coefficients.toArray().tolist(), base.intercept, float(sigmoid.coefficients[0]), sigmoid.intercept])
        drop_table(rows)
        model = CalibratedLogisticModel()
        model._set(state=json.dumps({"parts": parts}))
        return self._copyValues(model)


class CalibratedLogisticModel(_Scores, _HasState, Model, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getOrDefault("featuresCol"))
        total = F.lit(0.0)
        parts = self.learned()["parts"]
        for weights, bias, slope, shift in parts:
            terms = F.zip_with(x, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)
            margin = F.aggregate(terms, F.lit(float(bias)), lambda s, t: s + t)
            total = total + 1 / (1 + F.exp(-(F.lit(slope) * margin + F.lit(shift))))
        return self._with(dataset, total / len(parts))


class NeighbourClassifier(_Scores, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Share of class 1 among the ``k`` nearest fitted rows, each counting once or by 1 / distance."""

    k: Param[int] = _param("k", "neighbours", TypeConverters.toInt)
    weights: Param[str] = _param("weights", "uniform or distance", TypeConverters.toString)
    keyCol: Param[str] = _param("keyCol", "row key", TypeConverters.toString)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(k=5, weights="uniform", keyCol="key", featuresCol="features", labelCol="label")
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> NeighbourModel:
        get = self.getOrDefault
        if get("weights") not in ("uniform", "distance"):
            raise ValueError(f"unknown weights {get('weights')!r}")
        x = vector_to_array(get("featuresCol")).alias("x")
        rows = cut_lineage(dataset.select(F.col(get("keyCol")).alias("key"), F.col(get("labelCol")).cast("double").alias("y"), x))
        model = NeighbourModel()
        model._set(state=json.dumps({"rows": True, "k": get("k"), "weights": get("weights"), "key": get("keyCol"), "width": rows.agg(F.max(F.size("x"))).first()[0] or 0}))
        model.rows = rows
        return self._copyValues(model)


class NeighbourModel(_KeepsRows, _Scores, _HasState, Model):
    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.learned()
        key, names = state["key"], [f"x{i}" for i in range(state["width"])]
        wide = lambda x: [x[i].alias(n) for i, n in enumerate(names)]
        asked = dataset.select(F.col(key).alias("key"), *wide(vector_to_array(self.getOrDefault("featuresCol"))))
        near = knn_join(asked, self.rows.select("key", *wide(F.col("x"))), "key", names, state["k"])
        own = near.schema["neighbour"].dataType
        # rows meet rows: merged, as the size of a packed file says little about them
        met = near.join(self.rows.select(F.col("key").cast(own).alias("neighbour"), "y").hint("merge"), "neighbour")
        if state["weights"] == "distance":
            # an equal point outweighs all others
            same = met.groupBy("key").agg(F.avg(F.when(F.col("d2") == 0, F.col("y"))).alias("same"), (F.sum(F.when(F.col("d2") > 0, F.col("y") / F.col("distance"))) / F.sum(F.when(F.col("d2") > 0, 1 / F.col("distance")))).alias("far"))
            share = same.select("key", F.coalesce("same", "far").alias("_share"))
        else:
            share = met.groupBy("key").agg(F.avg("y").alias("_share"))
        joined = dataset.join(share.withColumnRenamed("key", "_near").hint("merge"), F.col(key).cast(own) == F.col("_near"), "left")
        return self._with(joined, F.coalesce("_share", F.lit(0.0))).drop("_near", "_share")
