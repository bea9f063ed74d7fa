"""Cases of the fourth round of findings: whole cross-validation, and learners that keep no wide copies of the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bindings import modelling
from riskloom.operators import margin, oversample
from riskloom.plans import boosting, models, training
from riskloom.plans.training import ModelSpec
from riskloom.session import shared_folder


@pytest.fixture()
def rows(spark):
    """300 rows with a category and a label that follows ``a``."""
    return spark.range(300).select(
        F.col("id").alias("key"), (F.col("id") * 37 % 101).cast("double").alias("a"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"),
        ((F.col("id") * 37 % 101 + F.col("id") * 7 % 60) > 80).cast("double").alias("label"),
    )


def tables(spark):
    """Intermediate tables of this run that are still there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(path)} if files.exists(path) else set()


def test_the_model_catalogue_runs_every_fold_of_every_repeat(spark, sf_dir, monkeypatch):
    def scored(folded, specs, key, k, repeats=1, seed=42, train_scores=False, first=0):
        """Predictions as of a learner that knows nothing, for the folds asked for."""
        assert folded.count() == modelling.rows(spark, sf_dir).count()
        titles = F.explode(F.array(*[F.lit(s.title) for s in specs])).alias("model")
        runs = [
            folded.select(titles, (r * k + F.col(f"fold_{r}")).alias("run"), F.lit("validation").alias("part"), key, "label", F.lit(0.5).alias("score"))
            for r in range(first, first + repeats)
        ]
        return training.cut_lineage(training.reduce(training.DataFrame.unionByName, runs))

    monkeypatch.setattr(training, "fold_predictions", scored)
    found = modelling.t11_model_catalogue(spark, sf_dir).collect()
    assert len(found) == 11 and {r["n_runs"] for r in found} == {30} and {r["mean"] for r in found} == {0.5}


def test_repeats_are_measured_apart_with_the_scores_of_one_call(spark, rows):
    specs = [ModelSpec("logreg", ["a"], ["c"], {"maxIter": 3}), ModelSpec("dtree", ["a"], ["c"], {"maxDepth": 2}), ModelSpec("dtree", ["a"], label="one")]
    folded = training.with_folds(rows, "key", 2, 2)
    whole = training.run_scores(training.fold_predictions(folded, specs, "key", 2, 2))
    expected = {(r["model"], r["run"]): r["auroc"] for r in whole.collect()}
    before = tables(spark)
    found = {(r["model"], r["run"]): r["value"] for r in training.cross_validate(rows, specs, "key", 2, 2).collect()}
    assert set(found) == set(expected) == {(s.title, i) for s in specs for i in range(4)}
    assert all(found[at] == pytest.approx(expected[at], abs=1e-12) for at in expected)
    assert len(tables(spark) - before) == 3  # the folds and the ranks of each repeat; training rows and predictions are gone


def test_boosting_leaves_no_tables(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "_FRESH", 2)
    data = training.preprocessor(ModelSpec("xgb", ["a"], ["c"]), "key").fit(rows).transform(rows).select("label", "features")
    before = tables(spark)
    boosting.BoostedTrees(maxIter=5, maxDepth=2).fit(data)
    assert tables(spark) == before


@pytest.fixture()
def crossed(spark):
    """400 rows of two classes that overlap, with their weights."""
    draw = np.random.default_rng(5)
    rows = [(i, *map(float, draw.normal(size=2) + (i % 5 == 0)), float(i % 5 == 0), 4.0 if i % 5 == 0 else 1.0) for i in range(400)]
    return spark.createDataFrame(rows, "id long, x double, y double, _label double, _w double")


def test_features_made_in_passes_give_the_fit_of_the_wide_table(spark, crossed):
    fourier = margin.FourierMap.drawn(2, 1.2, 32, 42)
    x = np.random.default_rng(1).normal(0, 50, (300, 2))
    wide = np.concatenate([z.copy() for _, z in fourier.blocks(x)])
    assert wide == pytest.approx(np.sqrt(2 / 32) * np.cos(x @ fourier.directions + fourier.phases), abs=1e-13)
    at = np.array(crossed.orderBy("id").select("x", "y").collect())
    z = np.sqrt(2 / 32) * np.cos(at @ fourier.directions + fourier.phases)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "id long, z array<double>")
    given = crossed.join(table, "id").withColumn("features", array_to_vector("z"))
    svm = LinearSVC(labelCol="_label", weightCol="_w", maxIter=40, regParam=1 / 640, standardization=False).fit(given)
    weights, shift = margin.fit_margin(crossed, ["x", "y"], fourier, 1 / 640, max_iter=40)
    assert weights == pytest.approx(svm.coefficients.toArray(), abs=1e-6) and shift == pytest.approx(svm.intercept, abs=1e-6)


def test_margin_seeds_write_no_wide_table(spark, crossed, monkeypatch):
    written = []
    plain = oversample.cut_lineage
    monkeypatch.setattr(oversample, "cut_lineage", lambda df, n=0: written.append(df.schema) or plain(df, n))
    seeds = oversample.margin_seeds(crossed.withColumn("label", F.col("_label").cast("int")), "label", "id", ["x", "y"])
    assert 1 <= seeds.count() <= 80
    assert [s.names for s in written] == [["key", "_label", "_x0", "_x1"]]


def test_deep_forests_keep_nodes_and_grow_the_same_trees(spark, rows):
    data = training.preprocessor(ModelSpec("rf", ["a"], ["c"]), "key").fit(rows).transform(rows)
    deep = models.classifier("rf", numTrees=4, maxDepth=7)
    assert deep.getCacheNodeIds() and not models.classifier("rf").getCacheNodeIds()
    walked = models.classifier("rf", numTrees=4, maxDepth=7, cacheNodeIds=False)
    text = lambda m: m.fit(data).toDebugString.split("\n", 1)[1]
    assert text(deep) == text(walked)
    assert training.side_by_side(2_250_000, [{"numTrees": 100, "maxDepth": 10}]) == 1
