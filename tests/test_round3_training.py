"""Cases of the third round of findings on training jobs: what their plans and written tables look like, and equal results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators.balance import class_weights, with_class_weight
from riskloom.plans import boosting, stages, training
from riskloom.plans.training import ModelSpec
from riskloom.plans.trees import Tree
from riskloom.session import cut_lineage


@pytest.fixture()
def rows(spark):
    """400 rows with a gap, a category and a label that follows ``a``."""
    return spark.range(400).select(
        F.col("id").alias("key"), F.when(F.col("id") % 9 != 0, (F.col("id") * 37 % 101).cast("double")).alias("a"),
        (F.col("id") * 53 % 89).cast("double").alias("b"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"),
        ((F.col("id") * 37 % 101 + F.col("id") * 7 % 60) > 80).cast("double").alias("label"),
    )


def test_class_weights_do_not_deal_the_rows_by_class(spark, rows):
    # without a broadcast limit Spark would deal all rows to one task per class
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighted = with_class_weight(rows, "label")
        spec = stages.Balanced(None, strategy="class_weight", keyCol="key")
        for df in (weighted, spec.resampled(rows)):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        found = {r["label"]: r["weight"] for r in weighted.select("label", "weight").distinct().collect()}
        assert weighted.count() == 400 and found == {r["label"]: r["weight"] for r in class_weights(rows, "label").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_decide_how_many_files_learners_read(spark, rows, monkeypatch):
    one = rows.coalesce(1)
    assert len(cut_lineage(one).inputFiles()) == 1 and len(cut_lineage(one, 100).inputFiles()) == 4
    monkeypatch.setattr(training, "FIT_ROWS", 100)
    folded = training.with_folds(one, "key", 2)
    assert len(folded.inputFiles()) == 4
    train, _, _ = training.prepared_fold(folded, ModelSpec("logreg", ["a", "b"], ["c"]), "key", 0)
    assert len(train.inputFiles()) >= 2


def test_fits_side_by_side_are_bounded_by_the_rows_they_keep():
    forests = [{"numTrees": 100}, {}]
    assert training.side_by_side(1000, forests) == training.side_by_side(4_500_000, []) == training.PARALLEL_FITS
    assert training.side_by_side(4_500_000, forests) == 1 and training.side_by_side(10**12, []) == 1
    assert training.side_by_side(2_250_000, forests) == 3


def test_specs_of_like_preparation_share_it_and_score_as_alone(spark, rows, monkeypatch):
    folded = training.with_folds(rows, "key", 2)
    specs = [ModelSpec("logreg", ["a", "b"], ["c"], {"maxIter": 5}), ModelSpec("dtree", ["a", "b"], ["c"], {"maxDepth": 3}, "class_weight"),
             ModelSpec("dtree", ["a"], [], {"maxDepth": 2}, label="narrow")]
    alone = [r for s in specs for r in training.fold_predictions(folded, [s], "key", 2, train_scores=True).collect()]
    fits = []
    plain = stages.Preprocessor._fit
    monkeypatch.setattr(stages.Preprocessor, "_fit", lambda self, df: fits.append(1) or plain(self, df))
    together = training.fold_predictions(folded, specs, "key", 2, train_scores=True).collect()
    assert len(fits) == 4  # two folds of two ways to prepare the rows
    by = lambda r: (r["model"], r["run"], r["key"])
    assert len(together) == len(alone) == 2 * 3 * 400
    for x, y in zip(sorted(alone, key=by), sorted(together, key=by)):
        assert x[:5] == y[:5] and x["score"] == pytest.approx(y["score"], abs=1e-9)


def test_constant_and_empty_columns_are_found_in_one_scan(spark):
    df = spark.createDataFrame(
        [(1.0, None, 2.0, "x", float("nan"), 1.0), (2.0, None, None, "x", float("nan"), 1.0), (1.0, None, 2.0, None, float("nan"), float("nan"))],
        "a double, empty double, one double, text string, nans double, nearly double",
    )
    spec = stages.Preprocessor(numeric=["a", "empty", "one", "nans", "nearly"], categorical=["text"])
    assert spec._kept(df) == (["a", "nearly"], [])
    spec = stages.Preprocessor(numeric=["a", "empty", "one"], categorical=["text"], dropConstant=False)
    assert spec._kept(df) == (["a", "one"], ["text"])


def test_histogram_sums_and_descent_equal_plain_loops():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 9, (500, 3)).astype(np.uint16)
    packed = pa.array([b"?" * 6, *[r.tobytes() for r in bins]], pa.binary()).slice(1)
    assert (boosting._bins_of(packed, 3) == bins).all() and (boosting._bins_of(packed.to_pylist(), 3) == bins).all()
    # root, an inner node on each side, four leaves
    zero = np.zeros(7)
    tree = Tree(np.array([0, 1, 2, -1, -1, -1, -1]), np.array([4, 3, 5, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]),
                np.array([2, 4, 6, -1, -1, -1, -1]), zero, zero, np.array([True, False, True, False, False, False, False]))

    def walk(row):
        node = 0
        while tree.feature[node] >= 0:
            b = row[tree.feature[node]]
            left = tree.missing_left[node] if b == 0 else b <= tree.threshold[node]
            node = tree.left[node] if left else tree.right[node]
        return node

    assert boosting._by_bin(tree, bins).tolist() == [walk(r) for r in bins]
    for scale in (1, 1 << 24, 1 << 50):  # the last one is beyond what a double holds exactly
        values, total, expected = rng.integers(-999, 999, 500) * scale + 1, np.zeros(9, np.int64), np.zeros(9, np.int64)
        boosting._add_up(total, bins[:, 0].astype(np.int64), values)
        np.add.at(expected, bins[:, 0], values)
        assert (total == expected).all()


def test_boosted_trees_are_the_same_for_one_file_or_many(spark, rows, monkeypatch):
    x = rows.select("label", array_to_vector(F.array(F.coalesce("a", F.lit(0.0)), "b")).alias("features")).coalesce(1)
    fit = lambda: boosting.BoostedTrees(maxIter=3, maxDepth=3).fit(x).getOrDefault("state")
    whole = fit()
    monkeypatch.setattr(boosting, "_FILE_ROWS", 64)
    assert fit() == whole
