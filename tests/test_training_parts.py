"""Boosting, tree attributions, estimators and the parameter search against hand-worked and brute-force results."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from riskloom.plans import models, search, trees
from riskloom.plans.boosting import BoostedTrees
from riskloom.plans.stages import Balanced, Preprocessor
from riskloom.plans.training import ModelSpec, fit_model, importance_selection, random_search
from riskloom.session import cut_lineage


def vectors(spark, x, y, w=None):
    rows = [(i, [float(v) for v in r], float(t), 1.0 if w is None else float(w[i])) for i, (r, t) in enumerate(zip(x, y))]
    return cut_lineage(spark.createDataFrame(rows, "id long, x array<double>, label double, w double").select("id", "label", "w", array_to_vector("x").alias("features")))


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.random((600, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * rng.standard_normal(600) > 0.9).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    return vectors(spark, x, y), x, y


def part(g, h, l1, l2):
    return max(abs(g) - l1, 0.0) ** 2 / (h + l2)


@pytest.mark.parametrize("l1,l2,least,gamma", [(0.0, 1.0, 1.0, 0.0), (0.5, 2.0, 3.0, 0.1)])
def test_first_tree_by_hand(spark, l1, l2, least, gamma):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (80, 2)).astype(float), rng.integers(0, 2, 80).astype(float)
    y[x[:, 0] > 3] = 1.0
    x[:7, 0] = np.nan
    w = rng.integers(1, 3, 80)
    spec = BoostedTrees(maxIter=1, maxDepth=1, baseScore=0.5, stepSize=0.3, regAlpha=l1, regLambda=l2, minChildWeight=least, gamma=gamma, weightCol="w")
    tree = spec.fit(vectors(spark, x, y, w)).ensemble().trees[0]
    g, h = (0.5 - y) * w, 0.25 * w
    found = []
    for j, c, left_missing in itertools.product(range(2), range(5), (True, False)):
        left = np.where(np.isnan(x[:, j]), left_missing, x[:, j] <= c)
        if h[left].sum() >= least and h[~left].sum() >= least:
            gain = part(g[left].sum(), h[left].sum(), l1, l2) + part(g[~left].sum(), h[~left].sum(), l1, l2) - part(g.sum(), h.sum(), l1, l2)
            found.append((gain, j, c, left_missing, left))
    gain, j, c, _, left = max(found, key=lambda f: f[0])
    assert gain >= gamma and (tree.feature[0], tree.threshold[0]) == (j, c)
    for side, rows in ((tree.left[0], left), (tree.right[0], ~left)):
        total = g[rows].sum()
        assert tree.value[side] == pytest.approx(-0.3 * math.copysign(max(abs(total) - l1, 0), total) / (h[rows].sum() + l2), abs=1e-6)
        assert tree.cover[side] == rows.sum()


def test_loss_never_rises_and_partitions_do_not_matter(spark, noisy):
    frame, x, y = noisy
    model = BoostedTrees(maxIter=8, maxDepth=3, stepSize=0.3).fit(frame)
    ensemble = model.ensemble()
    losses, margin = [], np.full(len(x), ensemble.bias)
    for tree in ensemble.trees:
        losses.append(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean())
        margin = margin + tree.predict(x)
    losses.append(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean())
    assert all(b <= a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.7 * losses[0]
    again = BoostedTrees(maxIter=8, maxDepth=3, stepSize=0.3).fit(frame.repartition(5, "label"))
    assert np.array_equal(again.ensemble().trees[0].threshold, ensemble.trees[0].threshold, equal_nan=True)
    assert np.allclose(again.ensemble().score(x), ensemble.score(x), atol=1e-6)
    out = model.transform(frame).orderBy("id").select(vector_to_array("probability")[1].alias("p"), "prediction").toPandas()
    assert ((out["p"] > 0.5) == (out["prediction"] > 0)).all() and ((out["p"] > 0.5) == (y > 0)).mean() > 0.85


def test_leaf_bound_takes_the_best_splits_first(spark, noisy):
    frame, x, y = noisy
    few = BoostedTrees(maxIter=1, maxDepth=0, maxLeaves=4, baseScore=0.5, minChildWeight=0.0, minRows=5).fit(frame).ensemble().trees[0]
    full = BoostedTrees(maxIter=1, maxDepth=0, maxLeaves=30, baseScore=0.5, minChildWeight=0.0, minRows=5).fit(frame).ensemble().trees[0]
    assert (few.feature < 0).sum() == 4 and 20 < (full.feature < 0).sum() <= 30
    assert few.feature[:3].tolist()[0] == full.feature[0] and few.threshold[0] == full.threshold[0]
    assert full.cover[full.feature < 0].min() >= 5 and full.cover[full.feature < 0].sum() == len(x)
    drawn = BoostedTrees(maxIter=1, maxDepth=2, subsample=0.5, colsample=0.5).fit(frame).ensemble().trees[0]
    assert 0.35 * len(x) < drawn.cover[0] < 0.65 * len(x) and len(set(drawn.feature[drawn.feature >= 0])) <= 2


def test_squares_and_empty_features(spark):
    x = np.arange(40.0)[:, None]
    model = BoostedTrees(objective="squared", maxIter=30, maxDepth=3, stepSize=0.5, regLambda=0.0).fit(vectors(spark, x, 3 * x[:, 0]))
    assert np.abs(model.ensemble().score(x) - 3 * x[:, 0]).max() < 4
    blank = BoostedTrees(maxIter=2, maxDepth=2).fit(vectors(spark, np.full((10, 2), np.nan), [0, 1] * 5))
    assert blank.ensemble().score(np.full((1, 2), np.nan))[0] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        BoostedTrees().fit(vectors(spark, np.zeros((0, 1)), []).limit(0))


@pytest.mark.parametrize("name", ["xgb", "xgb_balanced", "lgbm"])
def test_every_grid_entry_is_accepted(spark, noisy, name):
    points = models.parameter_grid(name)
    assert len(points) == {"xgb": 27, "xgb_balanced": 1215, "lgbm": 9}[name]
    for point in points:
        models.classifier(name, **point)
    for point in (points[0], points[-1]):
        fitted = models.classifier(name, maxIter=1, **point).fit(noisy[0])
        assert fitted.transform(noisy[0]).count() == 600


def test_every_catalogue_entry_has_a_grid_and_fits(spark, noisy):
    frame = noisy[0].withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda v: F.when(F.isnan(v), 0.5).otherwise(v))))
    for name in models.GRIDS:
        point = models.parameter_grid(name)[0] | {n: v for n, v in (("numTrees", 3), ("maxIter", 2)) if models.classifier(name).hasParam(n)}
        fitted = Balanced(models.classifier(name, key="id", **point), strategy=models.default_balancing(name), keyCol="id").fit(frame)
        assert models.with_score(fitted.transform(frame)).filter("score BETWEEN 0 AND 1").count() == 600
    with pytest.raises(ValueError):
        models.parameter_grid("nothing")


# attributions


def value_of(tree, x, known):
    def walk(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        if f in known:
            left = tree.missing_left[node] if np.isnan(x[f]) else (x[f] in tree.categories[node] if node in tree.categories else x[f] <= tree.threshold[node])
            return walk(tree.left[node] if left else tree.right[node])
        return sum(walk(c) * tree.cover[c] for c in (tree.left[node], tree.right[node])) / tree.cover[node]

    return walk(0)


def all_subsets(ensemble, x):
    d = len(x)
    out = np.zeros(d)
    for j in range(d):
        for size in range(d):
            for s in itertools.combinations([i for i in range(d) if i != j], size):
                share = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                out[j] += share * sum(w * (value_of(t, x, {*s, j}) - value_of(t, x, set(s))) for w, t in zip(ensemble.weights, ensemble.trees))
    return out


@pytest.mark.parametrize("kind", ["dtree", "rf", "gbt", "boosted"])
def test_attributions_equal_all_subsets(spark, noisy, kind):
    frame, x, _ = noisy
    x = np.where(np.isnan(x), 0.5, x) if kind != "boosted" else x
    ready = vectors(spark, x, noisy[2])
    learner = {
        "dtree": DecisionTreeClassifier(maxDepth=4), "rf": RandomForestClassifier(numTrees=4, maxDepth=4, seed=1),
        "gbt": GBTClassifier(maxIter=3, maxDepth=3, seed=1), "boosted": BoostedTrees(maxIter=3, maxDepth=4),
    }[kind]
    model = learner.fit(ready)
    ensemble = trees.ensemble_of(model, spark)
    found = ensemble.attributions(x[:40])
    for i in range(40):
        assert found[i] == pytest.approx(all_subsets(ensemble, x[i]), abs=1e-9)
    column = "probability" if kind in ("dtree", "rf") else "rawPrediction"
    own = {r["id"]: r["s"] for r in model.transform(ready).select("id", vector_to_array(column)[1].alias("s")).collect()}
    total = trees.tree_attributions(ready, ensemble, ["a", "b", "a", "c"], "id").groupBy("id").agg(F.sum("attribution").alias("s"), F.count("*").alias("n")).collect()
    assert len(total) == 600
    for r in total:
        assert r["n"] == 3 and r["s"] + ensemble.base() == pytest.approx(own[r["id"]], abs=1e-9)


def test_category_splits(spark):
    rows = [(i, "abcd"[i % 4], float(i % 4 in (1, 3))) for i in range(80)]
    frame = spark.createDataFrame(rows, "id long, c string, label double")
    model = fit_model(frame, ModelSpec("dtree", [], ["c"]), "id")
    ensemble = trees.ensemble_of(model.stages[-1], spark)
    score = trees.scores(ensemble, vector_to_array("features"), 4)
    for r in model.transform(frame).select("label", score.alias("own")).collect():
        assert r["own"] == r["label"]


# estimators


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(7)
    x = rng.random((300, 3))
    hole = rng.random(x.shape) < 0.1
    y = (x[:, 0] + 0.3 * (np.arange(300) % 3 == 0) > 1.0).astype(float)
    rows = [(i, *[None if h else float(v * s) for v, h, s in zip(r, g, (1, 1000, 1))], 7.0, None, ["u", "v", None][i % 3], float(t)) for i, (r, g, t) in enumerate(zip(x, hole, y))]
    return cut_lineage(spark.createDataFrame(rows, "id long, a double, b double, c double, same double, none double, g string, label double"))


def test_preprocessor_learns_from_the_fit_only(spark, cases):
    spec = Preprocessor(numeric=["a", "b", "none", "same"], categorical=["g"], keyCol="id")
    model = spec.fit(cases)
    assert model.slots() == ["a", "b", "g", "g", "g"]
    a = np.array([np.nan if r["a"] is None else r["a"] for r in cases.orderBy("id").collect()])
    filled = np.where(np.isnan(a), np.nanmedian(a), a)
    out = model.transform(cases).orderBy("id").select(vector_to_array("features").alias("f"), "a").collect()
    assert [r["f"][0] for r in out] == pytest.approx(list((filled - filled.mean()) / filled.std()))
    assert out[0]["f"][2:] == [0.0, 1.0, 0.0] and out[2]["f"][2:] == [1.0, 0.0, 0.0]  # missing, u, v
    new = spark.createDataFrame([(1, None, 5.0, None, None, None, "never seen", 0.0)], cases.schema)
    assert model.transform(new).select(vector_to_array("features").alias("f")).first()["f"][2:] == [0.0, 0.0, 0.0]
    whole = Preprocessor(numeric=["a", "none", "same"], dropMissing=False, dropConstant=False).fit(cases)
    assert whole.slots() == ["a", "none", "same"] and whole.transform(cases).select(vector_to_array("features")[2].alias("s")).distinct().count() == 1
    with pytest.raises(ValueError):
        Preprocessor(categorical=["g"], mostCategories=2).fit(cases)
    with pytest.raises(ValueError):
        Preprocessor(numeric=["a"], imputer="other").fit(cases)


@pytest.mark.parametrize("mode", ["simple", "knn", "iterative"])
def test_pipelines_save_and_load(spark, cases, tmp_path, mode):
    ready = Preprocessor(numeric=["a", "b", "c"], categorical=["g"], keyCol="id", imputer=mode, rounds=1, trees=2, learner="trees" if mode == "iterative" else "linear")
    pipeline = Pipeline(stages=[ready, Balanced(LogisticRegression(maxIter=5), strategy="random_over", keyCol="id")])
    pipeline.save(f"{tmp_path}/p")
    model = Pipeline.load(f"{tmp_path}/p").fit(cases)
    model.save(f"{tmp_path}/m")
    scores = lambda m: {r["id"]: r["score"] for r in models.with_score(m.transform(cases)).select("id", "score").collect()}
    assert len(scores(model)) == 300 and scores(PipelineModel.load(f"{tmp_path}/m")) == pytest.approx(scores(model))


def test_balancing_acts_in_the_fit_only(spark, cases):
    ready = Preprocessor(numeric=["a", "b", "c"], categorical=["g"], keyCol="id").fit(cases)
    x = ready.transform(cases)
    stage = Balanced(LogisticRegression(maxIter=5), strategy="smote", keyCol="id")
    even = {r["label"]: r["count"] for r in stage.resampled(x).groupBy("label").count().collect()}
    assert even[0.0] == even[1.0] and stage.fit(x).transform(x).count() == 300
    weighed = Balanced(LogisticRegression(), strategy="class_weight", keyCol="id").resampled(x)
    assert weighed.groupBy("label").agg(F.round(F.sum("weight"), 6).alias("w")).select("w").distinct().count() == 1
    with pytest.raises(ValueError):
        Balanced(models.classifier("knn", key="id"), strategy="class_weight", keyCol="id").fit(x)


def test_cross_validator_searches_the_inner_learner(cases):
    inner = LogisticRegression(maxIter=5, elasticNetParam=1.0)
    pipeline = Pipeline(stages=[Preprocessor(numeric=["a", "b"], categorical=["g"]), Balanced(inner, strategy="random_under", keyCol="id")])
    grid = ParamGridBuilder().addGrid(inner.regParam, [0.0, 1e6]).build()
    fitted = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=2, seed=1).fit(cases)
    assert fitted.avgMetrics[0] > fitted.avgMetrics[1] and isinstance(fitted.bestModel, PipelineModel)


def test_search_keeps_parameters_and_balancing(cases):
    model, table = random_search(cases, ModelSpec("dtree", ["a", "b"], ["g"], {"maxBins": 16}, "random_under"), "id", k=2, points=[{"maxDepth": 1}, {"maxDepth": 4}])
    assert table.count() == 2 and model.stages[-1].getOrDefault("maxBins") == 16
    assert model.stages[-1].numClasses == 2 and model.stages[-1].depth in (1, 2, 3, 4)
    rows = {r["feature"]: r for r in importance_selection(cases, ["a", "b", "none"], "id", categorical=["g"]).collect()}
    assert set(rows) == {"a", "b", "none", "g"} and rows["none"]["importance"] == 0 and rows["a"]["kept"]


# search


def test_density_ratio_search_beats_random_draws():
    space = {"a": list(range(50)), "b": list(range(50)), "c": ["x", "y", "z"], "d": [True, False]}
    surface = lambda p: -((p["a"] - 37) ** 2) / 100 - (p["b"] - 11) ** 2 / 100 + (p["c"] == "y") * 3 + p["d"]

    def run(seed):
        s = search.ParzenSearch(space, seed)
        for _ in range(60):
            p = s.propose()
            s.record(p, [surface(p)])
        return s

    assert [t[0] for t in run(3).trials] == [t[0] for t in run(3).trials]
    won = 0
    for seed in range(20):
        draw = random.Random(1000 + seed)
        plain = max(surface({n: draw.choice(v) for n, v in space.items()}) for _ in range(60))
        won += surface(run(seed).best(1)) >= plain
    assert won >= 15


def test_median_stop():
    s = search.ParzenSearch({"a": [1, 2]}, 0, patience=3)
    assert not s.stops([0.1])
    for v in (0.5, 0.6, 0.7):
        s.record({"a": 1}, [v, v])
    assert s.stops([0.55]) and not s.stops([0.6]) and s.stops([0.9, 0.1])
    s.record({"a": 2}, [0.99])  # stopped early: not the best of those measured in full
    assert s.best(2) == {"a": 1}
