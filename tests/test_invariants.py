"""Brute-force equality on small tables and invariants of the randomised operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_order
from riskloom.operators import association, components, compare, evaluate, knn, masked, local_outliers
from riskloom.operators import balance, oversample, prefix, quantiles, resample, split
from riskloom.plans import anomaly, models, training
from riskloom.plans.cohort import cohort


@pytest.fixture(scope="session")
def skewed(spark):
    """300 rows, a third with one value, ties elsewhere, some gaps."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = 5.0 if i % 3 == 0 else round(rng.uniform(0, 10), 1)
        y = round(x * 0.5 + rng.uniform(0, 4), 1)
        rows.append((i, x, None if i % 29 == 0 else y, int(rng.random() < 0.1 + x / 25)))
    df = spark.createDataFrame(rows, "id long, x double, y double, label int").cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def points(spark, sf_dir):
    df = cohort(spark, sf_dir).select("patient_id", "edad", "presion_arterial_sistolica", "mortality").cache()
    df.count()
    return df


COLUMNS = ["edad", "presion_arterial_sistolica"]


@pytest.mark.parametrize("bracket_rows", [10, 1_000_000])
def test_quantiles_are_exact_on_both_paths(skewed, bracket_rows):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.quantiles(skewed, ["x", "y"], probs, bracket_rows=bracket_rows)
    pdf = skewed.toPandas()
    for c in ("x", "y"):
        assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist())


def test_order_statistics_of_five_million_rows(spark):
    """A permutation of 0 .. n-1 whose lower third is one hot value: every rank is known."""
    n, hot = 5_000_000, 1_700_000
    spot = F.pmod(F.col("id") * 2_654_435_761, F.lit(n))
    df = spark.range(n).select(F.when(spot < hot, 7).otherwise(spot).cast("long").alias("v"), (-spot).cast("double").alias("w"))
    values = {"v": F.col("v"), "w": F.col("w")}
    ranks = {"v": [0, hot - 1, hot, 2_500_000, n - 1, n], "w": [0, 1, 4_999_000]}
    got = quantiles.order_statistics(df, values, ranks)
    assert {(k, (s.value, s.below, s.equal)) for k, s in got.items()} == {
        (("v", 0), (7, 0, hot)), (("v", hot - 1), (7, 0, hot)), (("v", hot), (hot, hot, 1)),
        (("v", 2_500_000), (2_500_000, 2_500_000, 1)), (("v", n - 1), (n - 1, n - 1, 1)),
        (("w", 0), (1 - n, 0, 1)), (("w", 1), (2 - n, 1, 1)), (("w", 4_999_000), (-999, 4_999_000, 1)),
    }


def test_text_ranges_split_a_common_prefix(spark):
    df = spark.range(20_000).select(F.format_string("https://example.org/a/long/path/%05d", "id").alias("w"))
    spread = prefix.with_text_range(df, "w").groupBy("_range").count()
    assert spread.count() > 200 and spread.agg(F.max("count")).first()[0] < 500


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert quantiles.quantiles(empty, ["x"], [0.5]) == {"x": [None]}


def test_running_sums_match_a_plain_sort(skewed):
    counts = skewed.groupBy("x").agg(F.count("*").alias("n"))
    got = {r.x: (r.n_before, r.n_total) for r in prefix.running_sums(counts, "x", ["n"]).collect()}
    before = 0
    for r in sorted(counts.collect(), key=lambda r: r.x):
        assert got[r.x] == (before, 300)
        before += r.n


def test_text_codes_share_prefixes(spark):
    words = [f"prefix-{i}" for i in range(40)] + ["", "é", "z", "aa"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.code for r in prefix.text_codes(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}


def test_kendall_matches_all_pairs(skewed):
    rows = [(r.x, r.y) for r in skewed.filter("y IS NOT NULL").collect()]
    s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s += np.sign(a - c) * np.sign(b - d)
        tx += a == c
        ty += b == d
    pairs = len(rows) * (len(rows) - 1) / 2
    expected = s / math.sqrt((pairs - tx) * (pairs - ty))
    assert association.kendall(skewed, "x", "y").first().tau == pytest.approx(expected)


def _auroc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def _ap(rows):
    total, p = 0.0, sum(y for y, _ in rows)
    for s in {s for _, s in rows}:
        at = [y for y, t in rows if t == s]
        above = [y for y, t in rows if t >= s]
        total += sum(at) * sum(above) / len(above)
    return total / p


def test_jackknife_matches_leaving_rows_out(spark, skewed):
    rows = [(r.label, round(r.x / 10, 2)) for r in skewed.limit(60).collect()]
    df = spark.createDataFrame(rows, "y int, s double")
    got = {r.metric: r for r in compare.jackknife(df, "y", "s").collect()}
    for metric, function in (("auroc", _auroc), ("auprc", _ap)):
        left = [function(rows[:i] + rows[i + 1 :]) for i in range(len(rows))]
        mean, n = np.mean(left), len(rows)
        se = math.sqrt((n - 1) / n * np.sum((left - mean) ** 2))
        assert got[metric]["mean"] == pytest.approx(mean)
        assert got[metric]["std_error"] == pytest.approx(se)
        half = (got[metric].ci_high - got[metric].ci_low) / 2
        standard = (got[metric].ci_standard_high - got[metric].ci_standard_low) / 2
        assert half == pytest.approx(standard / math.sqrt(n))


def test_bootstrap_agrees_with_point_and_jackknife(spark, sf_dir):
    df = cohort(spark, sf_dir).select("mortality", "p_points")
    drawn = {r.metric: r for r in resample.bootstrap(df, "mortality", "p_points", 300).collect()}
    left = {r.metric: r for r in compare.jackknife(df, "mortality", "p_points").collect()}
    for m in ("auroc", "auprc", "accuracy", "recall", "brier"):
        assert drawn[m]["mean"] == pytest.approx(left[m]["mean"], abs=3 * left[m].std_error / math.sqrt(300) + 2e-3)
        assert drawn[m]["std"] == pytest.approx(left[m].std_error, rel=0.2)


def test_bootstrap_difference_agrees_with_placements(spark, sf_dir):
    df = cohort(spark, sf_dir).select("mortality", "p_model", "p_points")
    drawn = resample.bootstrap_difference(df, "mortality", "p_model", "p_points", 300).first()
    exact = compare.delong(df, "mortality", "p_model", "p_points").first()
    assert drawn.difference == pytest.approx(exact.difference)
    assert drawn.se == pytest.approx(math.sqrt(exact.variance), rel=0.2)


def _nearest(rows, query, k, skip):
    ranked = sorted(
        ((sum((a - b) ** 2 for a, b in zip(query[1:], r[1:])), r[0]) for r in rows if not (skip and r[0] == query[0]))
    )
    return [key for _, key in ranked[:k]]


@pytest.mark.parametrize("block", [64, 8192])
def test_knn_join_is_exact(points, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK_POINTS", block)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", block)
    df = points.limit(500)
    rows = [(r.patient_id, r.edad, r.presion_arterial_sistolica) for r in df.collect()]
    df = df.sparkSession.createDataFrame(rows, "patient_id long, edad double, presion_arterial_sistolica double")
    got: dict = {}
    for r in knn.knn_join(df, df, "patient_id", COLUMNS, 4, skip_self=True).collect():
        got.setdefault(r.key, []).append((r.position, r.neighbour))
    for row in rows:
        assert [n for _, n in sorted(got[row[0]])] == _nearest(rows, row, 4, True)


def test_knn_join_with_hot_point(spark):
    rows = [(i, 1.0 if i % 2 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double")
    near = knn.knn_join(df.filter("id IN (1, 3, 2)"), df, "id", ["x"], 3, skip_self=True).collect()
    got = {k: [r.neighbour for r in sorted(near, key=lambda r: r.position) if r.key == k] for k in (1, 2, 3)}
    assert got[1] == [3, 5, 7]
    assert got[3] == [1, 5, 7]
    assert got[2] == [1, 3, 5]


def test_smote_rows_lie_between_their_parents(points):
    made = oversample.smote(points, "mortality", "patient_id", COLUMNS)
    counts = split.class_counts(points, "mortality")
    real = {r.patient_id: r for r in points.collect()}
    rows = made.collect()
    assert len(rows) == counts[0] - counts[1]
    for r in rows:
        a, b = real[r.parent], real[r.neighbour]
        assert a.mortality == b.mortality == 1
        for c in COLUMNS:
            low, high = sorted((a[c], b[c]))
            assert low - 1e-9 <= r[c] <= high + 1e-9


@pytest.mark.parametrize("strategy", ["adasyn", "borderline_smote", "svm_smote", "random_over", "random_under"])
def test_balancers_reach_parity(points, strategy):
    grown = oversample.balance(points, strategy, "mortality", "patient_id", COLUMNS)
    counts = split.class_counts(grown, "mortality")
    assert counts[0] == counts[1]


def test_cleaned_balancers_only_remove(points):
    kept = oversample.without_tomek_links(points, "mortality", "patient_id", COLUMNS)
    before, after = split.class_counts(points, "mortality"), split.class_counts(kept, "mortality")
    links = oversample.tomek_links(points, "mortality", "patient_id", COLUMNS).count()
    assert after[1] == before[1]
    assert before[0] - after[0] == links / 2


def test_folds_are_even_and_complete(points):
    folded = split.stratified_folds(points, "mortality", "patient_id", 7, 2)
    for r in range(2):
        counts = folded.groupBy("mortality", f"fold_{r}").count().collect()
        assert {c[f"fold_{r}"] for c in counts} == set(range(7))
        for y in (0, 1):
            sizes = [c["count"] for c in counts if c.mortality == y]
            assert max(sizes) - min(sizes) <= 1


def test_split_ties_are_broken_by_key(spark):
    df = spark.createDataFrame([(i, 7) for i in range(50)], "id long, t int")
    first = split.first_rows(df, [F.col("t").cast("bigint")], "id", {None: [13]})[0][(None, 13)]
    assert sorted(r.id for r in df.filter(first).collect()) == list(range(13))


def test_hash_order_is_stable(spark):
    value = spark.range(1).select(hash_order("id", 42).alias("h")).first().h
    import hashlib

    assert value == int(hashlib.md5(b"0:42").hexdigest()[:15], 16)


def test_over_sampling_repeats_rows_evenly(points):
    copies = balance.over_sample(points, "mortality", "patient_id").groupBy("mortality", "patient_id").count()
    spread = copies.groupBy("mortality").agg(F.max("count").alias("a"), F.min("count").alias("b")).collect()
    assert all(r.a - r.b <= 1 for r in spread)


@pytest.mark.parametrize("chunk", [40, 50_000])
def test_local_outlier_factor_does_not_depend_on_chunks(skewed, chunk):
    got = {r.value: r.lof for r in local_outliers.lof_by_value(skewed, "y", 5, chunk).collect()}
    whole = {r.value: r.lof for r in local_outliers.lof_by_value(skewed, "y", 5).collect()}
    assert got == pytest.approx(whole)


def test_forest_ranks_a_far_point_first(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(400, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    scored = anomaly.forest_classifier(df, "id", ["a", "b"], contamination=0.05, trees=50)
    assert scored.orderBy(F.desc("anomaly")).first().id == 400
    assert scored.filter("predicted = 1").count() == pytest.approx(20, abs=2)


def test_independent_components_are_uncorrelated(spark):
    rng = np.random.default_rng(0)
    s = np.c_[rng.uniform(-1, 1, 2000), rng.laplace(size=2000)]
    x = s @ np.array([[1.0, 0.5], [0.3, 1.0]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    result = components.independent_components(df, ["a", "b"], "id")
    got = np.array([[r.ic1, r.ic2] for r in result["sources"].orderBy("id").collect()])
    assert abs(np.corrcoef(got.T)[0, 1]) < 1e-6
    match = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert match.max(axis=1).min() > 0.98
    assert result["reconstruction_mse"] < 1e-12


def test_saved_experiment_scores_new_rows(spark, sf_dir, tmp_path):
    df = cohort(spark, sf_dir)
    spec = training.ModelSpec("logreg", ["edad", "creatinina"], ["indice_killip"], {"maxIter": 10})
    result = training.run_experiment(df, "mortality", "patient_id", [spec], 2, 1, save_to=str(tmp_path))
    rows = models.model_input(df, "mortality", "patient_id", ["edad", "creatinina"], ["indice_killip"])
    again = training.load_and_predict(str(tmp_path), rows)
    direct = models.predict(result["model"], rows, "logreg")
    gap = again.join(direct.select("patient_id", F.col("probability_1").alias("d")), "patient_id")
    assert gap.filter(F.abs(F.col("probability_1") - F.col("d")) > 1e-12).count() == 0
    with pytest.raises(ValueError):
        training.check_features(result["metadata"], df.drop("edad"))


def test_report_refuses_the_training_table(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, s double")
    with pytest.raises(ValueError):
        resample.evaluation_report(df, "y", "s", replicates=10, train_rows=2)


def test_event_rate_interval_contains_the_rate(points):
    rates = evaluate.event_rate_interval(points, "mortality", "edad").collect()
    assert all(r.ci_low <= r.event_rate <= r.ci_high for r in rates)


def test_text_keys_stay_apart(spark):
    rows = [(f"A{i:02d}", float(i), float(i % 3), int(i % 4 == 0)) for i in range(24)] + [("7", 40.0, 1.0, 0), ("007", 41.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "id string, x double, y double, label int")
    near = {r.key: r.neighbour for r in knn.knn_join(df, df, "id", ["x"], 1, skip_self=True).collect()}
    assert len(near) == 26 and near["7"] == "007" and near["A01"] == "A00"
    grown = oversample.balance(df, "smote", "label", "id", ["x", "y"])
    real = {r.id for r in grown.collect() if not r.id.startswith("-")}
    assert real == {r[0] for r in rows} and grown.filter("label = 1").count() == grown.filter("label = 0").count()
    gaps = df.withColumn("x", F.when(F.col("id") == "007", None).otherwise(F.col("x")))
    filled = masked.knn_impute(gaps, "id", ["x", "y"], 1)
    assert filled.columns == df.columns and filled.filter("x IS NULL").count() == 0
    first = split.first_rows(df, [F.lit(1).cast("bigint")], "id", {None: [2]})[0][(None, 2)]
    assert {r.id for r in df.filter(first).collect()} == {"007", "7"}
