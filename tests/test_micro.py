"""Hand-computed small tables for the rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scores, special
from riskloom.functions import fixed_values as fv
from riskloom.operators import association, balance, binning, compare, encode, evaluate, impute, split
from riskloom.operators.outliers import OutlierRule, fit_outliers
from riskloom.plans import cleaning
from riskloom.sources import tables


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def frame(spark, values, kind="double", name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} {kind}")


def test_risk_points_have_gaps_unless_contiguous(spark):
    df = frame(spark, [38.0, 39.0, 40.0, 49.0, 50.0])
    assert column(df.select(scores.range_points("x", fv.GRACE_AGE).alias("p")), "p") == [0, 0, 18, 0, 36]
    closed = df.select(scores.range_points("x", fv.GRACE_AGE, contiguous=True).alias("p"))
    assert column(closed, "p") == [0, 0, 18, 18, 36]


def test_admission_score_by_hand(spark):
    df = spark.createDataFrame([(65.0, 85.0, 120.0, 1.0)], "a double, h double, s double, c double")
    score = scores.grace_score("a", "h", "s", "c", F.lit(False), F.lit(True), F.lit(False), F.lit(1))
    row = df.select(score.alias("g"), scores.grace_band(score).alias("b")).first()
    assert (row.g, row.b) == (137, "intermediate")


def test_registry_variants_read_complications_differently(spark):
    texts = ["TV;bav3", "ESTV", "BAV2:1|ts", "pcr-fv, shock", "bav1", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = scores.tokens("t")
    token = df.select(
        scores.has_token(found, fv.TOKENS_VF + fv.TOKENS_VT).alias("v"),
        scores.has_token(found, fv.TOKENS_AVB_HIGH).alias("b"),
    ).collect()
    assert [r.v for r in token] == [True, False, False, True, False, False, False]
    assert [r.b for r in token] == [True, False, True, False, False, False, False]
    upper = F.upper(F.coalesce("t", F.lit("")))
    word = column(df.select(upper.rlike(fv.PATTERN_VF_VT_WORD).alias("w")), "w")
    part = column(df.select(upper.rlike(fv.PATTERN_VF_VT_PART).alias("w")), "w")
    assert word == [True, False, False, True, False, False, False]
    assert part == [True, True, False, True, False, False, False]


def test_missing_score_has_no_probability(spark):
    df = spark.createDataFrame([(None,), (13,), (-2,)], "s int")
    out = df.select(scores.registry_probability(F.col("s")).alias("p"), scores.pseudo_probability("s", 10).alias("q"))
    assert [tuple(r) for r in out.collect()] == [(None, None), (0.98, 1.0), (0.02, 0.0)]


def test_iqr_cap(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -100.0])
    model = fit_outliers(df, {"x": OutlierRule("iqr", "cap")})
    # quartiles 1.5 and 4.5: bounds -3 and 9
    assert sorted(column(model.transform(df), "x")) == [-3.0, 1.0, 2.0, 3.0, 4.0, 5.0, 9.0]
    assert model.counts(df) == {"x": 2}


def test_no_spread_means_no_outliers(spark):
    df = frame(spark, [3.0, 3.0, 3.0, 3.0, 99.0])
    assert fit_outliers(df, {"x": OutlierRule("modified_zscore")}).counts(df) == {"x": 0}
    flat = frame(spark, [2.0] * 5)
    assert fit_outliers(flat, {"x": OutlierRule("zscore")}).counts(flat) == {"x": 0}


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.0, 3.0], [math.log(2), math.log(4)]),
        ([0.0, 3.0], [1.0, 2.0]),
        ([4.0, None], [2.0, None]),
    ],
)
def test_transform_rule(spark, values, expected):
    df = frame(spark, values)
    out = column(fit_outliers(df, {"x": OutlierRule("iqr", "transform")}).transform(df).orderBy("id"), "x")
    assert [None if v is None else round(v, 9) for v in out] == [
        None if v is None else round(v, 9) for v in expected
    ]


def test_treatment_none_still_counts(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 100.0])
    model = fit_outliers(df, {"x": OutlierRule("iqr", "none")})
    assert model.counts(df) == {"x": 1}
    assert max(column(model.transform(df), "x")) == 100.0


def test_equal_quantile_edges_collapse(spark):
    df = frame(spark, [1.0] * 8 + [2.0, 3.0])
    bins = binning.fit_bins(df, "x", "quantile", 5)
    assert bins.edges == (1.0, 1.2000000000000002, 3.0) or len(bins.edges) == len(set(bins.edges))
    assert len(bins.labels) == len(bins.edges) - 1


def test_fitted_bins_are_left_closed_with_right_closed_labels(spark):
    df = frame(spark, [0.0, 5.0, 10.0])
    labels = column(binning.apply_bins(df, [binning.fit_bins(df, "x", "uniform", 2)]).orderBy("id"), "x")
    assert labels == ["[0.00, 5.00]", "(5.00, 10.00]", "(5.00, 10.00]"]


def test_label_codes_follow_text_order_and_missing_is_a_category(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (None,)], "v int")
    coded = encode.encode_labels(df.withColumn("o", F.col("v")), "v", encode.fit_labels(df, "v"))
    assert {r.o: r.v for r in coded.collect()} == {1: 0, 10: 1, 2: 2, None: 3}


def test_mode_tie_goes_to_smaller_value(spark):
    df = spark.createDataFrame([(10,), (9,), (9,), (10,), (None,)], "v int")
    assert impute.modes(df, ["v"]) == {"v": 9}


def test_fill_keeps_leading_gap_for_fallback(spark):
    df = frame(spark, [None, 1.0, None, 3.0, None])
    forward = impute.fill_ordered(df, ["x"], "id").orderBy("id")
    assert column(forward, "x") == [None, 1.0, 1.0, 3.0, 3.0]
    backward = impute.fill_ordered(df, ["x"], "id", backward=True, fallback={"x": 0.0}).orderBy("id")
    assert column(backward, "x") == [1.0, 1.0, 3.0, 3.0, 0.0]


def test_temporal_split_of_few_rows_has_no_test_rows(spark):
    df = spark.createDataFrame(
        [(i, f"2020-01-0{i + 1} 00:00:00") for i in range(4)], "id int, t string"
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert set(column(split.temporal_split(df, "t", "id", 0.2), "split")) == {"train"}


SIX = [(0, 0.2), (1, 0.8), (0, 0.3), (1, 0.25), (1, 0.7), (0, 0.7)]


def test_rank_measures_with_ties(spark):
    df = spark.createDataFrame(SIX, "y int, s double")
    row = evaluate.rank_measures(evaluate.ranked_scores(df, "y", "s")).first()
    assert round(row.auroc, 4) == 0.7222
    assert round(row.auprc, 4) == 0.7556


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert evaluate.auroc(df, "y", "s").first().auroc is None


def test_undefined_rates_are_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "y int, s double")
    row = evaluate.threshold_metrics(df, "y", "s").first()
    assert (row.precision, row.recall, row.f1, row.specificity, row.npv) == (0.0, 0.0, 0.0, 1.0, 0.5)


def test_corrected_chi2(spark):
    cells = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    df = spark.createDataFrame(cells, "p string, q string")
    row = association.chi2_test(df, "p", "q").first()
    n, ad_bc = 65, abs(10 * 5 - 20 * 30)
    expected = n * (ad_bc - n / 2) ** 2 / (30 * 35 * 40 * 25)
    assert row.chi2 == pytest.approx(expected)
    assert row.dof == 1


def test_superiority_ignores_the_sign_for_small_p(spark):
    df = spark.createDataFrame([(0.0001, -0.1), (0.5, -0.1), (0.5, 0.1), (0.5, 0.0)], "p double, d double")
    levels = column(df.select(compare.superiority(F.col("p"), F.col("d")).alias("l")), "l")
    assert levels == ["highly_significant", "inferior", "favorable_trend", "equivalent"]


def test_recommended_strategy(spark):
    df = spark.createDataFrame([(r,) for r in (2.0, 4.0, 8.0, 15.0, 30.0)], "r double")
    plain = column(df.select(balance.recommended_strategy(F.col("r"), False).alias("s")), "s")
    mixed = column(df.select(balance.recommended_strategy(F.col("r"), True).alias("s")), "s")
    assert plain == ["none", "class_weight", "smote", "adasyn", "smote_tomek"]
    assert mixed == ["none", "class_weight", "smote_nc", "smote_nc", "class_weight"]


def test_target_survives_the_constant_rule(spark):
    rows = [(i, float(i % 17), 1 if i == 0 else 0, "c") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y int, k string")
    model, cleaned = cleaning.fit_cleaning(df, cleaning.CleaningConfig(), target="y", key="id")
    assert model.removed == {"k": "nearly_constant"}
    assert cleaned.columns == ["id", "x", "y"]
    open_model, _ = cleaning.fit_cleaning(df, cleaning.CleaningConfig(drop_target=True), target="y", key="id")
    assert set(open_model.removed) == {"k", "y"}


def test_cleaning_model_applies_to_new_rows(spark):
    rows = [(i, float(i), None if i % 4 == 0 else float(i % 13), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, z double, c string")
    config = cleaning.CleaningConfig(numeric_imputation="median", outliers=OutlierRule("iqr", "cap"))
    model, cleaned = cleaning.fit_cleaning(df, config, key="id")
    assert cleaned.filter("z IS NULL").count() == 0
    new = spark.createDataFrame([(99, 1000.0, None, "zz")], df.schema)
    row = model.transform(new).first()
    assert row.x == model.outliers.fitted["x"].high
    assert (row.z, row.c) == (model.fills["z"], -1)


def test_duplicates_keep_the_first_key(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1.0)], "id int, c string, v double")
    assert sorted(column(cleaning.drop_duplicate_rows(df, "id"), "id")) == [1, 2]


def test_csv_with_latin_letters(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("id;peso\n1;12,5\n2;año\n".encode("latin-1"))
    back = tables.read_decimal_comma_csv(spark, str(path), ["peso"])
    assert [r.peso for r in back.orderBy("id").collect()] == [12.5, None]
    plain = tmp_path / "u.csv"
    plain.write_bytes("id,name\n1,niño\n".encode("latin-1"))
    assert tables.csv_encoding(spark, str(plain)) == "iso-8859-1"
    assert tables.read_table(spark, str(plain)).first().name == "niño"


def test_unknown_table_format(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "table.xyz")


def test_newest_snapshot_is_read(spark, tmp_path):
    from datetime import datetime

    root = str(tmp_path)
    tables.write_snapshot(spark.range(1), root, "m", datetime(2024, 1, 1))
    tables.write_snapshot(spark.range(2), root, "m", datetime(2024, 5, 1))
    tables.write_snapshot(spark.range(3), root, "other", datetime(2025, 1, 1))
    assert tables.read_latest_snapshot(spark, root, "m").count() == 2


def test_distribution_tails():
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.f_upper(4.102821015447, 2, 10) == pytest.approx(0.05, rel=1e-4)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)


def test_shapiro_wilk_published_example():
    w, p = compare.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005)
    assert p == pytest.approx(0.0067, abs=0.001)
