"""Thresholds below one half, csv cells with breaks and quotes, names of model parts, balancing without loss, clean-up."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import session
from riskloom.operators import oversample, profile
from riskloom.plans import cleaning, explain, training
from riskloom.sources import tables


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6])
def test_near_constant_at_any_threshold(spark, threshold):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 10 < 4, "top").otherwise(F.col("id").cast("string")).alias("forty"),
        F.when(F.col("id") % 100 < 7, 1).otherwise(F.col("id")).alias("seven"),
        F.col("id").alias("unique"),
        F.lit(None).cast("string").alias("gap"),
    )
    facts = {f.name: f.majority_share for f in profile.column_facts(rows, threshold=threshold)}
    assert facts["forty"] == (0.4 if threshold < 0.4 else None)
    assert facts["seven"] == (pytest.approx(0.07, abs=0.002) if threshold < 0.07 else None)
    assert facts["unique"] is None and facts["gap"] is None
    config = cleaning.CleaningConfig(constant_threshold=threshold)
    removed = cleaning.columns_to_remove(profile.column_facts(rows, threshold=threshold), config, [])
    assert ("forty" in removed) == (threshold < 0.4)


def test_csv_cells_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    rows = [(1, 'a "b" c'), (2, "one\ntwo"), (3, "x,y"), (4, "é")]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    tables.write_table(spark.createDataFrame(rows, schema), path)
    assert sorted(map(tuple, tables.read_table(spark, path, schema).collect())) == rows
    bad = str(tmp_path / "bad.csv")
    with open(bad, "w") as f:
        f.write("k,v\n1,a\n2,b,extra\n3,c\n")
    assert sorted(r["k"] for r in tables.read_csv(spark, bad, schema).collect()) == [1, 3]
    assert [r["line"] for r in tables.bad_csv_lines(spark, bad, schema).collect()] == ["2,b,extra"]


@pytest.fixture(scope="module")
def patients(spark):
    return spark.range(300).select(
        F.col("id"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double")).alias("a"),
        (F.col("id") * 53 % 97).cast("double").alias("b"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("c"),
        (F.col("id") % 7 == 0).cast("double").alias("label"),
    )


@pytest.mark.parametrize("strategy", ["none", "random_over", "smote", "smote_nc", "smote_tomek", "tomek"])
def test_balancing_keeps_rows_and_categories(spark, patients, strategy):
    out = oversample.balance(patients, strategy, "label", "id", ["a", "b"], categories=["c"])
    assert {"a", "b", "c", "label"} <= set(out.columns) and out.filter("c IS NULL").count() == 0
    if strategy not in ("tomek", "smote_tomek"):
        assert out.join(patients.select("id"), "id").select("id").distinct().count() == 300


def test_balanced_model_with_categories(spark, patients):
    spec = training.ModelSpec("logreg", ["a", "b"], ["c"], {"maxIter": 5}, balancing="smote")
    model = training.fit_model(patients, spec, "id")
    rows = {r["feature"]: r["importance"] for r in explain.model_importance(model, ["a", "b", "c"], spark).collect()}
    assert set(rows) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        explain.model_importance(model, ["a", "b"], spark)


def test_run_folder_is_cleaned(spark):
    before = session.shared_folder(spark)
    table = session.cut_lineage(spark.range(5))
    folder = before.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(folder)
    session.drop_table(table)
    assert os.listdir(folder) is not None and session.clean_up(spark) and not os.path.exists(folder)
    assert session.clean_up(spark) is False
