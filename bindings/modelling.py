"""Training, decomposition, anomaly and explanation jobs on the cohort."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bindings.base import cohort, query, r6, rounded, table, with_cohort
from bindings.inference import hash_sql
from riskloom.functions import bands, scores
from riskloom.operators.impute import apply_fills, fit_fills
from riskloom.operators import compare, components, knn
from riskloom.operators.outliers import OutlierRule, fit_outliers
from riskloom.operators.split import random_split
from riskloom.plans import anomaly, boosting, chained, explain, models, stages, training, trees
from riskloom.plans.training import ModelSpec
from riskloom.session import cut_lineage, shared_folder
from riskloom.streaming.scoring import read_file_stream, score_stream

KEY = "patient_id"
NUMERIC = ["edad", "presion_arterial_sistolica", "creatinina", "frecuencia_cardiaca"]
CATEGORICAL = ["indice_killip", "sexo"]
LOGREG = ModelSpec("logreg", NUMERIC, CATEGORICAL, {"maxIter": 15})
TREE = ModelSpec("dtree", NUMERIC, CATEGORICAL, {"maxDepth": 4})


def rows(spark, sf_dir, categorical=CATEGORICAL):
    return cut_lineage(models.model_input(cohort(spark, sf_dir), "mortality", KEY, NUMERIC, categorical), stages.FIT_ROWS)


def dense(spark, sf_dir):
    """All rows, numbers only; gaps hold the column's median."""
    data = models.model_input(cohort(spark, sf_dir), "mortality", KEY, NUMERIC)
    return cut_lineage(apply_fills(data, fit_fills(data, {c: "median" for c in NUMERIC})))


PLAIN = ModelSpec("logreg", NUMERIC, (), {"maxIter": 15})


def _place_sql(columns, first):
    """One row per (patient, place of the feature vector)."""
    parts = [
        f"""SELECT patient_id, {first + i} AS place, (coalesce({c}, f.m_{c}) - f.a_{c}) / f.s_{c} AS v FROM cohort, f"""
        for i, c in enumerate(columns)
    ]
    return parts


_FACTS = ", ".join(f"median({c}) AS m_{c}" for c in NUMERIC)
_SPREADS = ", ".join(f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in NUMERIC)
_LEVELS = " UNION ALL ".join(f"SELECT {i} AS j, '{c}' AS c, coalesce({c}, 'missing') AS v FROM cohort GROUP BY ALL" for i, c in enumerate(CATEGORICAL))
_LEVEL_OF = " ".join(f"WHEN '{c}' THEN coalesce({c}, 'missing')" for c in CATEGORICAL)


@query(
    "t6_preprocessing_pipeline",
    with_cohort(
        f""", m AS (SELECT {_FACTS} FROM cohort), f AS (SELECT {', '.join(f'any_value(m_{c}) AS m_{c}' for c in NUMERIC)}, {_SPREADS} FROM cohort, m),
        l AS (SELECT c, v, {len(NUMERIC)} - 1 + row_number() OVER (ORDER BY j, v) AS place FROM ({_LEVELS}))
        SELECT patient_id, CAST(place AS INT) AS place, {r6('v', 'v')} FROM ({' UNION ALL '.join(_place_sql(NUMERIC, 0))}
        UNION ALL SELECT patient_id, place, (CASE l.c {_LEVEL_OF} END = l.v)::INT::DOUBLE FROM cohort, l)"""
    ),
)
def t6_preprocessing_pipeline(spark, sf_dir):
    """Exact medians, population scale, every level of a category; one row per place of the feature vector."""
    data = rows(spark, sf_dir)
    model = stages.Preprocessor(numeric=NUMERIC, categorical=CATEGORICAL, keyCol=KEY).fit(data)
    return rounded(model.transform(data).select(KEY, F.posexplode(models.vector_to_array("features")).alias("place", "v")))


@query("t6_iterative_imputer")
def t6_iterative_imputer(spark, sf_dir):
    columns = [*NUMERIC, "filtrado_glomerular"]
    data = models.model_input(cohort(spark, sf_dir), "mortality", KEY, columns)
    fitted_on = stages.Preprocessor(numeric=columns, keyCol=KEY, imputer="iterative", learner="linear", scale=False).fit(cut_lineage(data))
    return fitted_on.filled(data).select(KEY, *[f"{c}_filled" for c in columns])


@query("t6_feature_selection")
def t6_feature_selection(spark, sf_dir):
    spec = stages.Preprocessor(numeric=NUMERIC, categorical=CATEGORICAL, keyCol=KEY, selection=True, selectionTrees=50)
    return spark.createDataFrame([(i, s) for i, s in enumerate(spec.fit(rows(spark, sf_dir)).slots())], "place int, column string")


@query("t7_cross_validation")
def t7_cross_validation(spark, sf_dir):
    return training.cross_validate(rows(spark, sf_dir), [LOGREG, TREE], KEY, k=3, repeats=1)


@query("t7_cross_validation_smote")
def t7_cross_validation_smote(spark, sf_dir):
    spec = ModelSpec("logreg", NUMERIC, CATEGORICAL, {"maxIter": 15}, balancing="smote")
    return training.cross_validate(rows(spark, sf_dir), [spec], KEY, k=2, repeats=1)


@query("t8_nested_cv")
def t8_nested_cv(spark, sf_dir):
    return training.nested_cross_validate(rows(spark, sf_dir), LOGREG, KEY, outer=3, inner=3, draws=4)


@query("t9_random_search")
def t9_random_search(spark, sf_dir):
    return training.random_search(rows(spark, sf_dir), LOGREG, KEY, draws=8, k=3)[1]


@query("t9_grid_search_balanced")
def t9_grid_search_balanced(spark, sf_dir):
    spec = ModelSpec("logreg", NUMERIC, CATEGORICAL, {"maxIter": 15}, balancing="random_under")
    return training.grid_search(rows(spark, sf_dir), spec, KEY, k=2)[1]


_SMALL_FOREST = {"numTrees": [10, 15, 20], "maxDepth": [2, 3, 4, 5, 6], "minInstancesPerNode": [1, 2, 5, 10], "balancing": ["none", "class_weight"]}


@query("t10_density_ratio_search")
def t10_density_ratio_search(spark, sf_dir):
    spec = ModelSpec("rf", NUMERIC, CATEGORICAL)
    return training.density_ratio_search(rows(spark, sf_dir), spec, KEY, trials=8, k=2, space=_SMALL_FOREST, startup=5)[1]


@query("t10_halving_search")
def t10_halving_search(spark, sf_dir):
    return training.halving_search(rows(spark, sf_dir), ModelSpec("rf", NUMERIC, CATEGORICAL), KEY, draws=4, rounds=2, k=2)


@query("t11_model_catalogue")
def t11_model_catalogue(spark, sf_dir):
    specs = [
        LOGREG, TREE, ModelSpec("rf", NUMERIC, CATEGORICAL, {"numTrees": 10}),
        ModelSpec("gbt", NUMERIC, CATEGORICAL, {"maxIter": 5}),
        ModelSpec("gbt_balanced", NUMERIC, CATEGORICAL, {"maxIter": 5}),
        ModelSpec("logreg_calibrated", NUMERIC, CATEGORICAL), ModelSpec("dtree_balanced", NUMERIC, CATEGORICAL),
        ModelSpec("rf_balanced", NUMERIC, CATEGORICAL, {"numTrees": 10}),
        ModelSpec("xgb", NUMERIC, CATEGORICAL, {"maxIter": 5}), ModelSpec("xgb_balanced", NUMERIC, CATEGORICAL, {"maxIter": 5, "scalePosWeight": 10.3}),
        ModelSpec("lgbm", NUMERIC, CATEGORICAL, {"maxIter": 3}),
    ]
    return training.summarise_runs(training.cross_validate(rows(spark, sf_dir), specs, KEY))


@query(
    "t11_boosted_first_split",
    with_cohort(
        f""", b AS (SELECT edad, count(*) AS n, sum(0.5 - mortality) AS g, count(*) * 0.25 AS h FROM cohort GROUP BY edad),
        c AS (SELECT edad, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS g, sum(h) OVER () AS h FROM b WINDOW w AS (ORDER BY edad)),
        s AS (SELECT edad, gl, hl, g, h, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM c WHERE h - hl >= 1 AND hl >= 1)
        SELECT edad AS threshold, {r6('-0.1 * gl / (hl + 1)', 'left_value')}, {r6('-0.1 * (g - gl) / (h - hl + 1)', 'right_value')}
        FROM s ORDER BY gain DESC, edad LIMIT 1"""
    ),
)
def t11_boosted_first_split(spark, sf_dir):
    """The first split of regularised boosting: threshold and leaf values of a stump that starts at 0.5."""
    data = models.model_input(cohort(spark, sf_dir), "mortality", KEY, ["edad"])
    vectors = data.select("label", array_to_vector(F.array("edad")).alias("features"))
    tree = boosting.BoostedTrees(maxIter=1, maxDepth=1, baseScore=0.5).fit(vectors).ensemble().trees[0]
    row = (float(tree.threshold[0]), float(tree.value[tree.left[0]]), float(tree.value[tree.right[0]]))
    return rounded(spark.createDataFrame([row], "threshold double, left_value double, right_value double"))


_TEST = f"row_number() OVER (ORDER BY {hash_sql('patient_id', '42')}, patient_id) <= ceil(count(*) OVER () * 0.2 - 1e-9)"
_FILLED = ", ".join(f"coalesce({c}, m_{c})::DOUBLE AS {c}" for c in NUMERIC)
_APART = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUMERIC)


@query("t11_neighbour_weights")
def t11_neighbour_weights(spark, sf_dir):
    data = cut_lineage(random_split(rows(spark, sf_dir), KEY))
    spec = ModelSpec("knn", NUMERIC, CATEGORICAL, {"k": 7, "weights": "distance"})
    model = training.fit_model(data.filter("split = 'train'"), spec, KEY)
    return models.predict(model, data.filter("split = 'test'"), "knn").select(KEY, "probability_1", "predicted")


@query("t11_regression")
def t11_regression(spark, sf_dir):
    data = cohort(spark, sf_dir).withColumn("target", F.col("escala_grace"))
    numbers = models.model_input(data, "target", KEY, NUMERIC, CATEGORICAL)
    return training.cross_validate_regression(cut_lineage(numbers), [ModelSpec("linreg", NUMERIC, CATEGORICAL)], KEY, k=3)


@query(
    "t11_knn_classifier",
    with_cohort(
        f""", m AS (SELECT {_FACTS} FROM cohort), x AS (SELECT patient_id, mortality AS y, {_TEST} AS test, {_FILLED} FROM cohort, m),
        near AS (SELECT a.patient_id AS key, min({{'d2': {_APART}, 'k': b.patient_id, 'y': b.y}}, 5) AS l FROM x a, x b WHERE a.test AND NOT b.test GROUP BY 1)
        SELECT key, {r6('list_avg(list_transform(l, lambda s: s.y))', 'probability')} FROM near"""
    ),
)
def t11_knn_classifier(spark, sf_dir):
    data = cut_lineage(random_split(dense(spark, sf_dir), KEY))
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    return rounded(knn.knn_vote(train, test, KEY, NUMERIC, "label", 5))


@query("t12_platt_calibration")
def t12_platt_calibration(spark, sf_dir):
    data = rows(spark, sf_dir)
    base, sigmoid = training.platt_calibration(data, LOGREG, KEY, k=2)
    return training.calibrated(base, sigmoid, data).select(KEY, "label", "score", "calibrated")


@query("t13_mlp")
def t13_mlp(spark, sf_dir):
    data = rows(spark, sf_dir)
    model = training.fit_model(data, ModelSpec("mlp", NUMERIC, CATEGORICAL, {"maxIter": 20}), KEY)
    return models.predict(model, data, "mlp").select(KEY, "probability_1", "predicted")


@query("t14_stacking")
def t14_stacking(spark, sf_dir):
    bases, meta, weights = training.stack(rows(spark, sf_dir), [LOGREG, TREE], KEY, k=2)
    return weights


@query("t14_stacked_scores")
def t14_stacked_scores(spark, sf_dir):
    data = rows(spark, sf_dir)
    bases, meta, _ = training.stack(data, [LOGREG, TREE], KEY, k=2)
    return training.stacked_scores(bases, meta, data).select(KEY, "label", "score")


@query("t15_isolation_forest")
def t15_isolation_forest(spark, sf_dir):
    return anomaly.forest_classifier(dense(spark, sf_dir), KEY, NUMERIC, trees=100)


@query("c10_isolation_forest_outliers")
def c10_isolation_forest_outliers(spark, sf_dir):
    data = cohort(spark, sf_dir).select(KEY, "creatinina")
    model = fit_outliers(data, {"creatinina": OutlierRule("isolation_forest", "cap")})
    return model.flags(data).groupBy("creatinina_outlier").agg(F.count("*").alias("n"))


@query("c20_chained_imputation")
def c20_chained_imputation(spark, sf_dir):
    data = cohort(spark, sf_dir).select(KEY, "edad", "creatinina", "filtrado_glomerular")
    return chained.chained_imputation(data, KEY, ["edad", "creatinina", "filtrado_glomerular"], rounds=2, learner="linear")


@query("t16_learning_curve")
def t16_learning_curve(spark, sf_dir):
    return training.learning_curve(rows(spark, sf_dir), LOGREG, KEY, shares=(0.3, 0.6, 1.0), k=2)


@query("t16_curve_diagnosis")
def t16_curve_diagnosis(spark, sf_dir):
    curve = training.learning_curve(rows(spark, sf_dir), TREE, KEY, shares=(0.3, 0.6, 1.0), k=2)
    return training.diagnose_curve(curve)


@query("t20_balancer_grid")
def t20_balancer_grid(spark, sf_dir):
    return training.balancer_grid(rows(spark, sf_dir), [LOGREG, TREE], ["none", "class_weight", "random_under", "random_over"], KEY, k=2)


@query("t21_experiment")
def t21_experiment(spark, sf_dir):
    specs = [LOGREG, TREE]
    result = training.run_experiment(cohort(spark, sf_dir), "mortality", KEY, specs, k=2, repeats=2)
    return result["metadata"]


@query("e14_pairwise_model_tests")
def e14_pairwise_model_tests(spark, sf_dir):
    runs = training.cross_validate(rows(spark, sf_dir), [LOGREG, TREE], KEY, k=3, repeats=1)
    return compare.pairwise_model_tests(cut_lineage(runs))


@query("f3_forward_selection")
def f3_forward_selection(spark, sf_dir):
    return training.forward_selection(dense(spark, sf_dir), NUMERIC, KEY, limit=2, k=2)


@query("f4_prefix_sweep")
def f4_prefix_sweep(spark, sf_dir):
    return training.prefix_sweep(dense(spark, sf_dir), NUMERIC, [1, 3], ["logreg", "dtree"], KEY, k=2)


@query("f5_importance_selection")
def f5_importance_selection(spark, sf_dir):
    return training.importance_selection(rows(spark, sf_dir), NUMERIC, KEY, categorical=CATEGORICAL)


@query("d13_pca")
def d13_pca(spark, sf_dir):
    return components.principal_components(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])[0]


@query("d13_pca_new_rows")
def d13_pca_new_rows(spark, sf_dir):
    """Fitted on one part of the rows, applied to the others and taken back."""
    data = cut_lineage(random_split(dense(spark, sf_dir), KEY))
    fitted_on = components.fit_principal_projection(data.filter("split = 'train'"), NUMERIC)
    scored = fitted_on.inverse_transform(fitted_on.transform(data.filter("split = 'test'")))
    return scored.select(KEY, "c1", "c2", *[f"{c}_back" for c in NUMERIC])


@query("f9_ica_new_rows")
def f9_ica_new_rows(spark, sf_dir):
    data = cut_lineage(random_split(dense(spark, sf_dir), KEY))
    fitted_on = components.fit_independent_projection(data.filter("split = 'train'"), NUMERIC, KEY, 3, rounds=20)
    return fitted_on.transform(data.filter("split = 'test'"), "ic").select(KEY, "ic1", "ic2", "ic3")


@query("d14_loading_importance")
def d14_loading_importance(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    _, loadings = components.principal_components(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return components.loading_importance(loadings, 2)


@query("f9_ica")
def f9_ica(spark, sf_dir):
    return components.independent_components(dense(spark, sf_dir), NUMERIC, KEY, 3, rounds=20)["components"]


@query("f10_pca_ica_comparison")
def f10_pca_ica_comparison(spark, sf_dir):
    return components.compare_components(dense(spark, sf_dir), NUMERIC, KEY, 2)


def fitted(spark, sf_dir):
    data = dense(spark, sf_dir)
    return data, training.fit_model(data, PLAIN, KEY)


@query("x1_batch_prediction")
def x1_batch_prediction(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    return models.predict(model, data, "logreg").select(KEY, "predicted", "probability_1", "model")


@query(
    "x2_risk_strata",
    with_cohort(
        f"""SELECT CASE WHEN p_model < 0.1 THEN 'Low' WHEN p_model < 0.3 THEN 'Moderate' ELSE 'High' END AS stratum,
        CAST(count(*) AS BIGINT) AS n, {r6('avg(mortality)', 'event_rate')} FROM cohort GROUP BY 1"""
    ),
)
def x2_risk_strata(spark, sf_dir):
    data = cohort(spark, sf_dir)
    return rounded(
        data.groupBy(bands.risk_stratum("p_model").alias("stratum")).agg(
            F.count("*").alias("n"), F.avg("mortality").alias("event_rate")
        )
    )


@query("x3_permutation_importance")
def x3_permutation_importance(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    return explain.permutation_importance(data, model, NUMERIC, KEY, repeats=2)


@query("x4_partial_dependence")
def x4_partial_dependence(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    return explain.partial_dependence(data, model, ["edad", "creatinina"])


_WEIGHTS = {"edad": 0.03, "presion_arterial_sistolica": -0.01, "frecuencia_cardiaca": 0.005}


@query(
    "x5_linear_attributions",
    with_cohort(
        " UNION ALL ".join(
            f"SELECT patient_id, '{c}' AS feature, {r6(f'{w} * ({c} - avg({c}) OVER ())', 'attribution')} FROM cohort"
            for c, w in _WEIGHTS.items()
        )
    ),
)
def x5_linear_attributions(spark, sf_dir):
    return rounded(explain.linear_attributions(cohort(spark, sf_dir).select(KEY, *_WEIGHTS), _WEIGHTS, KEY))


# A fixed tree: edad <= 60 ? 0.1 : (creatinina <= 2 or missing ? 0.3 : 0.7)
_AT_AGE = "CASE WHEN creatinina IS NULL OR creatinina <= 2 THEN 0.3 ELSE 0.7 END"


@query(
    "x5_tree_attributions",
    with_cohort(
        f""", c AS (SELECT avg((edad <= 60)::INT) AS young, avg((edad > 60 AND (creatinina IS NULL OR creatinina <= 2))::INT) / avg((edad > 60)::INT) AS low FROM cohort),
        v AS (SELECT patient_id, CASE WHEN edad <= 60 THEN 0.1 ELSE {_AT_AGE} END AS full_value,
            CASE WHEN edad <= 60 THEN 0.1 ELSE low * 0.3 + (1 - low) * 0.7 END AS age_only,
            young * 0.1 + (1 - young) * {_AT_AGE} AS creat_only, young * 0.1 + (1 - young) * (low * 0.3 + (1 - low) * 0.7) AS neither FROM cohort, c)
        SELECT patient_id, 'edad' AS feature, {r6('(age_only - neither + full_value - creat_only) / 2', 'attribution')} FROM v
        UNION ALL SELECT patient_id, 'creatinina', {r6('(creat_only - neither + full_value - age_only) / 2', 'attribution')} FROM v"""
    ),
)
def x5_tree_attributions(spark, sf_dir):
    """Attributions of a given tree whose covers are the counts of the table's rows."""
    data = cohort(spark, sf_dir)
    older, low = F.col("edad") > 60, F.col("creatinina").isNull() | (F.col("creatinina") <= 2)
    n = data.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate((F.lit(True), ~older, older, older & low, older & ~low))]).first()
    tree = trees.Tree(
        feature=np.array([0, -1, 1, -1, -1]), threshold=np.array([60.0, np.nan, 2.0, np.nan, np.nan]), left=np.array([1, -1, 3, -1, -1]),
        right=np.array([2, -1, 4, -1, -1]), value=np.array([0, 0.1, 0, 0.3, 0.7]), cover=np.array(list(n), float), missing_left=np.array([False, False, True, False, False]),
    )
    found = trees.tree_attributions(data, trees.Ensemble([tree], [1.0]), ["edad", "creatinina"], KEY, F.array("edad", "creatinina"))
    return rounded(found)


def _additive(name):
    """Attributions plus base equal the model's own score, row by row."""

    def run(spark, sf_dir):
        data = rows(spark, sf_dir)
        model = training.fit_model(data, ModelSpec(name, NUMERIC, CATEGORICAL, {"maxIter": 5} if name in ("gbt", "xgb") else {}), KEY)
        found, base = explain.model_attributions(model, data, KEY)
        total = found.groupBy(KEY).agg((F.sum("attribution") + F.lit(base)).alias("explained"))
        column = "rawPrediction" if name in ("gbt", "xgb") else "probability"
        own = model.transform(data).select(KEY, models.vector_to_array(column)[1].alias("own"))
        # as many rows on both sides: a file's size says little about them, so neither side is to be sent through the driver
        return rounded(total.join(own.hint("merge"), KEY).select(KEY, (F.col("explained") - F.col("own")).alias("gap")))

    return run


for _name in ("dtree", "rf", "gbt", "xgb"):
    query(f"x5_tree_sum_{_name}", with_cohort("SELECT patient_id, 0.0::DOUBLE AS gap FROM cohort"))(_additive(_name))


@query("x5_top_tree_attributions")
def x5_top_tree_attributions(spark, sf_dir):
    data = rows(spark, sf_dir)
    model = training.fit_model(data, ModelSpec("rf", NUMERIC, CATEGORICAL), KEY)
    return explain.top_attributions(explain.model_attributions(model, data, KEY)[0], KEY, 3)


@query("x5_sampled_attributions")
def x5_sampled_attributions(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    return explain.mean_attributions(explain.sampled_attributions(data, model, NUMERIC, KEY, samples=2))


@query("x6_model_importance")
def x6_model_importance(spark, sf_dir):
    return explain.model_importance(fitted(spark, sf_dir)[1], NUMERIC, spark)


@query("x7_sensitivity_sweep")
def x7_sensitivity_sweep(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    return explain.sensitivity_sweep(data, model, ["edad", "creatinina"], KEY)


@query("x8_counterfactuals")
def x8_counterfactuals(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    return explain.counterfactuals(data, model, ["presion_arterial_sistolica", "creatinina"], KEY, target=0.05)


@query(
    "stream_point_scores",
    with_cohort(
        """SELECT patient_id, CAST((edad >= 65)::INT + (edad >= 75)::INT + coalesce((diabetes_mellitus = 1)::INT, 0)
        + (hipertension_arterial = 1)::INT + (infarto_miocardio_agudo = 1)::INT AS INT) AS timi FROM cohort"""
    ),
)
def stream_point_scores(spark, sf_dir):
    """The cohort written as files, scored by a file stream, and read back."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = cohort(spark, sf_dir).drop("fecha_ingreso")
    source.write.parquet(f"{root}/in")
    stream = read_file_stream(spark, f"{root}/in", source.schema)
    timi = scores.timi_simple(
        "edad", F.col("diabetes_mellitus") == 1, F.col("hipertension_arterial") == 1,
        F.col("infarto_miocardio_agudo") == 1,
    )
    job = score_stream(stream, lambda s: s.select(KEY, timi.alias("timi")), f"{root}/out", f"{root}/state")
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out")

