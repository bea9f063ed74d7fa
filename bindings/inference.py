"""Score comparison, leave-one-out intervals, splits, balancing and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import cohort, query, r6, rounded, table, with_cohort
from bindings.evaluation import AP_SQL, HIST_SQL, LONG_SQL, PAIRS_SQL, both_models, predictions
from riskloom.operators import advice, balance, compare, split

# every left-out value by definition: take one row out of the score table and measure again
_LEFT_OUT = """, h AS (SELECT p_points AS score, sum(mortality)::BIGINT AS pos, sum(1 - mortality)::BIGINT AS neg FROM cohort GROUP BY 1),
  o AS (SELECT score AS os, 1 AS oy, pos AS w FROM h WHERE pos > 0 UNION ALL SELECT score, 0, neg FROM h WHERE neg > 0),
  g AS (SELECT os, oy, w, score, pos - (score = os AND oy = 1)::INT AS pos, neg - (score = os AND oy = 0)::INT AS neg FROM h, o),
  t AS (SELECT os, oy, any_value(w) AS w, sum(pos) AS p, sum(neg) AS q, sum(pos * (score >= 0.5)::INT) AS tp, sum(neg * (score >= 0.5)::INT) AS fp,
     sum(pos * power(score - 1, 2) + neg * power(score, 2)) AS err FROM g GROUP BY ALL),
  x AS (SELECT a.os, a.oy, a.score, a.pos, sum(CASE WHEN b.score < a.score THEN b.neg WHEN b.score = a.score THEN 0.5 * b.neg ELSE 0 END) AS wins,
     sum(CASE WHEN b.score >= a.score THEN b.pos ELSE 0 END) AS tpc, sum(CASE WHEN b.score >= a.score THEN b.pos + b.neg ELSE 0 END) AS called
     FROM g a JOIN g b ON a.os = b.os AND a.oy = b.oy GROUP BY ALL),
  r AS (SELECT os, oy, sum(pos * wins) AS wins, sum(CASE WHEN called > 0 THEN pos * tpc / called ELSE 0 END) AS ap FROM x GROUP BY ALL),
  v AS (SELECT w, wins / (p * q) AS auroc, ap / p AS auprc, (tp + q - fp) / (p + q) AS accuracy, tp / (tp + fp) AS precision, tp / p AS recall,
     2 * tp / (2 * tp + fp + p - tp) AS f1, err / (p + q) AS brier FROM t JOIN r USING (os, oy)),
  u AS (UNPIVOT v ON auroc, auprc, accuracy, precision, recall, f1, brier INTO NAME metric VALUE x),
  m AS (SELECT metric, sum(w) AS n, sum(w * x) / sum(w) AS mean FROM u GROUP BY 1)
  SELECT metric, CAST(any_value(n) AS BIGINT) AS n, """


@query(
    "e11_jackknife",
    with_cohort(
        _LEFT_OUT
        + f"""{r6('any_value(mean)', 'mean')}, {r6('sqrt((any_value(n) - 1) / any_value(n) * sum(w * power(x - mean, 2)))', 'std_error')}
        FROM u JOIN m USING (metric) GROUP BY metric"""
    ),
)
def e11_jackknife(spark, sf_dir):
    result = compare.jackknife(predictions(spark, sf_dir), "mortality", "p_points")
    return rounded(result.select("metric", "n", "mean", "std_error"))


@query(
    "e12_delong",
    with_cohort(
        f""", e AS (SELECT p_model, p_points, count(*) AS w FROM cohort WHERE mortality = 1 GROUP BY ALL),
        z AS (SELECT p_model, p_points, count(*) AS w FROM cohort WHERE mortality = 0 GROUP BY ALL),
        k AS (SELECT e.p_model AS e1, e.p_points AS e2, z.p_model AS z1, z.p_points AS z2, e.w AS ew, z.w AS zw,
          CASE WHEN e.p_model > z.p_model THEN 1 WHEN e.p_model = z.p_model THEN 0.5 ELSE 0 END AS k1,
          CASE WHEN e.p_points > z.p_points THEN 1 WHEN e.p_points = z.p_points THEN 0.5 ELSE 0 END AS k2 FROM e, z),
        v10 AS (SELECT any_value(ew) AS w, sum(zw * k1) / sum(zw) AS a, sum(zw * k2) / sum(zw) AS b FROM k GROUP BY e1, e2),
        v01 AS (SELECT any_value(zw) AS w, sum(ew * k1) / sum(ew) AS a, sum(ew * k2) / sum(ew) AS b FROM k GROUP BY z1, z2),
        m AS (SELECT sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b, sum(w) AS p FROM v10), q AS (SELECT sum(w) AS q FROM v01),
        s AS (SELECT (SELECT sum(w * power((v10.a - m.a) - (v10.b - m.b), 2)) / (any_value(p) - 1) / any_value(p) FROM v10, m)
          + (SELECT sum(w * power((v01.a - m.a) - (v01.b - m.b), 2)) / (any_value(q) - 1) / any_value(q) FROM v01, m, q) AS v)
        SELECT CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, {r6('a', 'auc_1')}, {r6('b', 'auc_2')}, {r6('a - b', 'difference')},
        {r6('v * 1000', 'variance')}, {r6('(a - b) / sqrt(v)', 'z')} FROM m, q, s"""
    ),
)
def e12_delong(spark, sf_dir):
    result = compare.delong(predictions(spark, sf_dir), "mortality", "p_model", "p_points")
    return rounded(result.withColumn("variance", F.col("variance") * 1000).drop("p_value"))


def _nri_sql(a: str, b: str) -> str:
    return with_cohort(
        f""", n AS (SELECT count(*) FILTER (mortality = 1) AS ne, count(*) FILTER (mortality = 0) AS nn,
        sum(CASE WHEN mortality = 1 THEN sign({a} - {b}) END) AS e, -sum(CASE WHEN mortality = 0 THEN sign({a} - {b}) END) AS n FROM cohort),
        s AS (SELECT *, e / ne AS x, n / nn AS y, sqrt(power(e / ne, 2) / ne + power(n / nn, 2) / nn) AS se FROM n)
        SELECT CAST(ne AS BIGINT) AS n_events, CAST(nn AS BIGINT) AS n_nonevents, {r6('x + y', 'nri')}, {r6('x', 'nri_events')},
        {r6('y', 'nri_nonevents')}, {r6('se', 'se')}, {r6('(x + y) / se', 'z')} FROM s"""
    )


@query("e15_nri", _nri_sql("p_model", "p_points"))
def e15_nri(spark, sf_dir):
    return rounded(
        compare.net_reclassification(predictions(spark, sf_dir), "mortality", "p_model", "p_points").drop("p_value")
    )


_CATS = "((({c} >= 0)::INT + ({c} >= 0.1)::INT + ({c} >= 0.3)::INT + ({c} >= 1)::INT))"


@query("e15_nri_categorical", _nri_sql(_CATS.format(c="p_model"), _CATS.format(c="p_points")))
def e15_nri_categorical(spark, sf_dir):
    return rounded(
        compare.net_reclassification(
            predictions(spark, sf_dir), "mortality", "p_model", "p_points", [0.0, 0.1, 0.3, 1.0]
        ).drop("p_value")
    )


@query(
    "e16_idi",
    with_cohort(
        f""", m AS (SELECT mortality AS y, count(*) AS n, avg(p_model) AS a, avg(p_points) AS b, var_pop(p_model) + var_pop(p_points) AS v
          FROM cohort GROUP BY 1), s AS (SELECT e.a - z.a AS sn, e.b - z.b AS so, sqrt(e.v / e.n + z.v / z.n) AS se
          FROM m e, m z WHERE e.y = 1 AND z.y = 0)
        SELECT {r6('sn', 'separation_new')}, {r6('so', 'separation_old')}, {r6('sn - so', 'idi')}, {r6('se', 'se')},
        {r6('(sn - so) / se', 'z')} FROM s"""
    ),
)
def e16_idi(spark, sf_dir):
    return rounded(
        compare.discrimination_improvement(predictions(spark, sf_dir), "mortality", "p_model", "p_points").drop("p_value")
    )


@query(
    "e17_comparison_report",
    with_cohort(
        f""", {LONG_SQL}, {HIST_SQL}, {PAIRS_SQL},
        a AS (SELECT max(auroc) FILTER (model = 'p_model') AS x, max(auroc) FILTER (model = 'p_points') AS y FROM auc),
        b AS (SELECT avg(power(p_model - mortality, 2)) AS bm, avg(power(p_points - mortality, 2)) AS bs,
          avg(((p_model >= 0.5)::INT = mortality)::INT) AS am, avg(((p_points >= 0.5)::INT = mortality)::INT) AS aps,
          sum((p_model >= 0.5 AND mortality = 1)::INT) / sum(mortality) AS sm, sum((p_points >= 0.5 AND mortality = 1)::INT) / sum(mortality) AS ss,
          sum((p_model < 0.5 AND mortality = 0)::INT) / sum(1 - mortality) AS fm, sum((p_points < 0.5 AND mortality = 0)::INT) / sum(1 - mortality) AS fs,
          sum(CASE WHEN mortality = 1 THEN sign(p_model - p_points) END) / sum(mortality) AS ne,
          -sum(CASE WHEN mortality = 0 THEN sign(p_model - p_points) END) / sum(1 - mortality) AS nn,
          avg(CASE WHEN mortality = 1 THEN p_model - p_points END) - avg(CASE WHEN mortality = 0 THEN p_model - p_points END) AS idi FROM cohort)
        SELECT {r6('x', 'model_auc')}, {r6('y', 'score_auc')}, {r6('x - y', 'auc_difference')}, {r6('ne + nn', 'nri')}, {r6('ne', 'nri_events')},
        {r6('nn', 'nri_nonevents')}, {r6('idi', 'idi')}, {r6('bm', 'model_brier')}, {r6('bs', 'score_brier')}, {r6('bm - bs', 'brier_difference')},
        {r6('am', 'model_accuracy')}, {r6('aps', 'score_accuracy')}, {r6('sm', 'model_sensitivity')}, {r6('ss', 'score_sensitivity')},
        {r6('fm', 'model_specificity')}, {r6('fs', 'score_specificity')} FROM a, b"""
    ),
)
def e17_comparison_report(spark, sf_dir):
    report = compare.comparison_report(predictions(spark, sf_dir), "mortality", "p_model", "p_points")
    unchecked = ["auc_z", "auc_p", "nri_p", "idi_p", "auc_ci_low", "auc_ci_high", "superiority", "direction"]
    return rounded(report.drop(*unchecked))


@query("e17_superiority")
def e17_superiority(spark, sf_dir):
    report = compare.comparison_report(predictions(spark, sf_dir), "mortality", "p_model", "p_points")
    return report.select("auc_difference", "auc_ci_low", "auc_ci_high", "auc_p", "superiority", "direction")


@query(
    "t18_model_ranking",
    with_cohort(
        f""", {LONG_SQL}, {HIST_SQL}, {PAIRS_SQL}, {AP_SQL},
        c AS (SELECT model, sum((score >= 0.3 AND mortality = 1)::INT) AS tp, sum((score >= 0.3 AND mortality = 0)::INT) AS fp, sum(mortality) AS p FROM long GROUP BY 1),
        m AS (SELECT model, auroc, (SELECT sum(pos * precision) / sum(pos) FROM ap WHERE ap.model = c.model) AS auprc,
          2 * tp / (tp + fp + p) AS f1, tp / p AS recall FROM c JOIN auc USING (model)),
        w AS (SELECT model, 0.7 * auroc + 0.1 * auprc + 0.1 * f1 + 0.1 * recall AS s, auroc >= 0.6 AS ok, auroc FROM m)
        SELECT model, {r6('s', 'weighted_score')}, {r6('auroc', 'primary_score')}, ok AS meets_thresholds,
        CAST(row_number() OVER (ORDER BY ok DESC, s DESC, model) AS INT) AS rank FROM w"""
    ),
)
def t18_model_ranking(spark, sf_dir):
    metrics = compare.model_metrics(both_models(spark, sf_dir), "mortality", "score", "model", 0.3)
    return rounded(compare.rank_models(metrics, thresholds={"auroc": 0.6}))


@query(
    "t18_metric_differences",
    with_cohort(
        f""", {LONG_SQL}, {HIST_SQL}, {PAIRS_SQL}, b AS (SELECT model, avg(power(score - mortality, 2)) AS brier FROM long GROUP BY 1),
        m AS (SELECT model, 'auroc' AS metric, auroc AS v FROM auc UNION ALL SELECT model, 'brier', brier FROM b)
        SELECT x.model AS model_1, y.model AS model_2, metric, {r6('x.v', 'value_1')}, {r6('y.v', 'value_2')}, {r6('x.v - y.v', 'difference')}
        FROM m x JOIN m y USING (metric) WHERE x.model < y.model"""
    ),
)
def t18_metric_differences(spark, sf_dir):
    metrics = compare.model_metrics(both_models(spark, sf_dir), "mortality", "score", "model")
    return rounded(compare.metric_differences(metrics).filter(F.col("metric").isin("auroc", "brier")))


def hash_sql(key: str, seed: str) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15))::BIGINT"


@query(
    "t1_random_split",
    with_cohort(
        f"""SELECT patient_id, CASE WHEN row_number() OVER (ORDER BY {hash_sql('patient_id', '42')}, patient_id)
          <= ceil(count(*) OVER () / 5) THEN 'test' ELSE 'train' END AS split FROM cohort"""
    ),
)
def t1_random_split(spark, sf_dir):
    return split.random_split(cohort(spark, sf_dir).select("patient_id"), "patient_id")


@query(
    "t2_temporal_split",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts DESC, event_id DESC) <= floor(count(*) OVER () / 5)
      THEN 'test' ELSE 'train' END AS split FROM events""",
)
def t2_temporal_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return split.temporal_split(events, "ts", "event_id").drop("ts")


@query(
    "t2_temporal_split_ties",
    with_cohort(
        """SELECT patient_id, CASE WHEN row_number() OVER (ORDER BY fecha_ingreso DESC, patient_id DESC)
        <= floor(count(*) OVER () / 10) THEN 'test' ELSE 'train' END AS split FROM cohort"""
    ),
)
def t2_temporal_split_ties(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "fecha_ingreso")
    return split.temporal_split(rows, "fecha_ingreso", "patient_id", 0.1).drop("fecha_ingreso")


@query(
    "t3_stratified_split",
    with_cohort(
        f"""SELECT patient_id, mortality, CASE WHEN row_number() OVER (PARTITION BY mortality ORDER BY {hash_sql('patient_id', '42')}, patient_id)
        <= floor(count(*) OVER (PARTITION BY mortality) / 5 + 0.5) THEN 'test' ELSE 'train' END AS split FROM cohort"""
    ),
)
def t3_stratified_split(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "mortality")
    return split.stratified_split(rows, "mortality", "patient_id")


@query(
    "t4_split_precedence",
    with_cohort(
        f"""SELECT split, mortality, CAST(count(*) AS BIGINT) AS n FROM (SELECT mortality, CASE WHEN row_number() OVER (PARTITION BY mortality
        ORDER BY {hash_sql('patient_id', '7')}, patient_id) <= floor(count(*) OVER (PARTITION BY mortality) / 4 + 0.5) THEN 'test' ELSE 'train' END AS split
        FROM cohort) GROUP BY ALL"""
    ),
)
def t4_split_precedence(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "mortality")
    parts = split.split_rows(rows, "patient_id", target="mortality", fraction=0.25, seed=7)
    return parts.groupBy("split", "mortality").agg(F.count("*").alias("n"))


@query(
    "t5_stratified_folds",
    with_cohort(
        "SELECT patient_id, mortality, "
        + ", ".join(
            f"""CAST(floor((row_number() OVER (PARTITION BY mortality ORDER BY {hash_sql('patient_id', f'42-{r}')}, patient_id) - 1) * 5
            / count(*) OVER (PARTITION BY mortality)) AS INT) AS fold_{r}"""
            for r in range(2)
        )
        + " FROM cohort"
    ),
)
def t5_stratified_folds(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "mortality")
    return split.stratified_folds(rows, "mortality", "patient_id", k=5, repeats=2)


@query(
    "i1_imbalance",
    with_cohort(
        f"""SELECT CAST(max(n) AS BIGINT) AS n_max, CAST(min(n) AS BIGINT) AS n_min, CAST(count(*) AS BIGINT) AS n_classes,
        {r6('max(n) / min(n)', 'ratio')}, max(n) / min(n) >= 3 AS is_imbalanced,
        CASE WHEN max(n) / min(n) < 3 THEN 'none' WHEN max(n) / min(n) > 20 THEN 'smote_tomek' WHEN max(n) / min(n) > 10 THEN 'adasyn'
          WHEN max(n) / min(n) > 5 THEN 'smote' ELSE 'class_weight' END AS strategy
        FROM (SELECT mortality, count(*) AS n FROM cohort GROUP BY 1)"""
    ),
)
def i1_imbalance(spark, sf_dir):
    return rounded(balance.imbalance(cohort(spark, sf_dir).select("mortality"), "mortality"))


@query(
    "i3_class_weights",
    f"""SELECT label, CAST(n AS BIGINT) AS n, {r6('s / (k * n)', 'weight')} FROM
    (SELECT label, count(*) AS n, sum(count(*)) OVER () AS s, count(*) OVER () AS k FROM embeddings GROUP BY label)""",
)
def i3_class_weights(spark, sf_dir):
    return rounded(balance.class_weights(table(spark, sf_dir, "embeddings").select("label"), "label"))


@query(
    "i3_row_weights_sqrt",
    with_cohort(
        f"""SELECT mortality, {r6('sqrt(any_value(s) / (any_value(k) * any_value(n)))', 'weight')}, CAST(count(*) AS BIGINT) AS n_rows,
        {r6('any_value(z) / any_value(e)', 'scale_pos_weight')}
        FROM cohort JOIN (SELECT mortality, count(*) AS n, sum(count(*)) OVER () AS s, count(*) OVER () AS k FROM cohort GROUP BY 1) USING (mortality),
        (SELECT sum(1 - mortality) AS z, sum(mortality) AS e FROM cohort) GROUP BY mortality"""
    ),
)
def i3_row_weights_sqrt(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "mortality")
    weighted = balance.with_class_weight(rows, "mortality", "sqrt_balanced")
    ratio = balance.positive_weight_ratio(rows, "mortality").scalar()
    grouped = weighted.groupBy("mortality").agg(F.max("weight").alias("weight"), F.count("*").alias("n_rows"))
    return rounded(grouped.withColumn("scale_pos_weight", ratio))


@query(
    "i4_over_sample",
    with_cohort(
        f""", r AS (SELECT patient_id, mortality, row_number() OVER (PARTITION BY mortality ORDER BY {hash_sql('patient_id', '42')}, patient_id) AS rn,
          count(*) OVER (PARTITION BY mortality) AS n FROM cohort), m AS (SELECT max(n) AS m FROM r)
        SELECT patient_id, mortality, CAST(unnest(range(CAST(m // n + (rn <= m % n)::INT AS BIGINT))) AS INT) AS copy FROM r, m"""
    ),
)
def i4_over_sample(spark, sf_dir):
    return balance.over_sample(cohort(spark, sf_dir).select("patient_id", "mortality"), "mortality", "patient_id")


@query(
    "i5_under_sample",
    with_cohort(
        f""", r AS (SELECT patient_id, mortality, row_number() OVER (PARTITION BY mortality ORDER BY {hash_sql('patient_id', '42')}, patient_id) AS rn,
          count(*) OVER (PARTITION BY mortality) AS n FROM cohort)
        SELECT patient_id, mortality FROM r WHERE rn <= (SELECT min(n) FROM r)"""
    ),
)
def i5_under_sample(spark, sf_dir):
    return balance.under_sample(cohort(spark, sf_dir).select("patient_id", "mortality"), "mortality", "patient_id")


@query(
    "i14_balance_report",
    with_cohort(
        f""", c AS (SELECT mortality, count(*) AS n, max(count(*)) OVER () AS m, min(count(*)) OVER () AS l FROM cohort GROUP BY 1)
        SELECT CAST(mortality AS VARCHAR) AS class, CAST(n AS BIGINT) AS n_before, CAST(m AS BIGINT) AS n_after, CAST(m - n AS BIGINT) AS added,
        {r6('m / l', 'ratio_before')}, CAST(1 AS DOUBLE) AS ratio_after FROM c"""
    ),
)
def i14_balance_report(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "mortality")
    return rounded(balance.balance_report(rows, balance.over_sample(rows, "mortality", "patient_id"), "mortality"))


_ANALYSED = ["edad", "creatinina", "filtrado_glomerular", "escala_grace", "sexo", "indice_killip", "fecha_ingreso"]


@query(
    "d18_dataset_analysis",
    with_cohort(
        f""", k AS (SELECT count(*) AS k, max(n) / min(n) AS ratio FROM (SELECT count(*) AS n FROM cohort GROUP BY mortality)),
        v AS (SELECT unnest([var_samp(edad), var_samp(creatinina), var_samp(filtrado_glomerular), var_samp(escala_grace)]) AS v FROM cohort)
        SELECT CAST(count(*) AS BIGINT) AS n_samples, CAST(7 AS INT) AS n_features, CAST(4 AS INT) AS n_numeric, CAST(2 AS INT) AS n_categorical, true AS has_datetime,
        {r6('100 * (3 - count(creatinina) / count(*) - count(filtrado_glomerular) / count(*) - count(escala_grace) / count(*)) / 7', 'missing_pct')},
        CAST((abs(skewness(edad)) > 1)::INT + (abs(skewness(creatinina)) > 1)::INT + (abs(skewness(filtrado_glomerular)) > 1)::INT + (abs(skewness(escala_grace)) > 1)::INT AS INT) AS n_skewed,
        CAST(any_value(k) AS BIGINT) AS n_classes, {r6('any_value(ratio)', 'imbalance_ratio')}, any_value(ratio) > 3 AS is_imbalanced,
        CAST((abs(corr(edad, creatinina)) > 0.9)::INT + (abs(corr(edad, filtrado_glomerular)) > 0.9)::INT + (abs(corr(edad, escala_grace)) > 0.9)::INT
          + (abs(corr(creatinina, filtrado_glomerular)) > 0.9)::INT + (abs(corr(creatinina, escala_grace)) > 0.9)::INT + (abs(corr(filtrado_glomerular, escala_grace)) > 0.9)::INT AS BIGINT) AS n_correlated_pairs,
        (SELECT CAST(count(*) AS BIGINT) FROM v WHERE v < (SELECT quantile_cont(v, 0.05) FROM v)) AS n_low_variance,
        CASE WHEN count(*) < 500 THEN 'small' WHEN count(*) < 5000 THEN 'medium' WHEN count(*) < 50000 THEN 'large' ELSE 'very_large' END AS size_class
        FROM cohort, k"""
    ),
)
def d18_dataset_analysis(spark, sf_dir):
    return rounded(advice.analyse(cohort(spark, sf_dir).select("mortality", *_ANALYSED), "mortality"))


@query(
    "d18_advice",
    with_cohort(
        """, a AS (SELECT count(*) AS n, sum(1 - mortality) / sum(mortality) AS ratio, corr(edad, escala_grace) AS r,
          100 * (3 - count(creatinina) / count(*) - count(filtrado_glomerular) / count(*) - count(escala_grace) / count(*)) / 7 AS missing FROM cohort)
        SELECT unnest([0, 1, 2]) AS position, unnest(['SMOTE', 'class_weight', 'xgb_balanced']) AS technique,
          unnest(['imbalance', 'imbalance', 'model']) AS category, 'high' AS priority FROM a WHERE ratio > 5
        UNION ALL SELECT 3, 'simple_imputation', 'preprocessing', 'medium' FROM a WHERE missing > 0 AND missing < 5
        UNION ALL SELECT 7, 'remove_correlated', 'feature_engineering', 'medium' FROM a WHERE abs(r) > 0.9
        UNION ALL SELECT 8, 'pca', 'feature_engineering', 'low' FROM a WHERE abs(r) > 0.9
        UNION ALL SELECT 10, 'variance_threshold', 'feature_engineering', 'low'
        UNION ALL SELECT 12, 'xgboost', 'model', 'high' FROM a WHERE n >= 5000
        UNION ALL SELECT 14, 'automl', 'model', 'medium'
        UNION ALL SELECT 15, 'repeated_cv', 'evaluation', 'medium' FROM a WHERE n < 1000
        UNION ALL SELECT 16, 'auprc', 'evaluation', 'high' FROM a WHERE ratio > 3"""
    ),
)
def d18_advice(spark, sf_dir):
    return advice.advice(advice.analyse(cohort(spark, sf_dir).select("mortality", *_ANALYSED), "mortality"))
