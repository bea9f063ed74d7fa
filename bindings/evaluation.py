"""Evaluation of the two cohort scores; AUROC texts use the pair-count definition on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import cohort, query, r6, rounded, table, with_cohort
from bindings.scores import PART_SCORE_SQL, TIMI_STEMI_SQL, timi_stemi_column
from riskloom.functions import bands, scores
from riskloom.operators import evaluate


def predictions(spark, sf_dir):
    return cohort(spark, sf_dir).select("patient_id", "mortality", "p_model", "p_points")


def both_models(spark, sf_dir):
    """Long form: one row per case and model."""
    return predictions(spark, sf_dir).unpivot(
        ["patient_id", "mortality"], ["p_model", "p_points"], "model", "score"
    )


LONG_SQL = """long AS (
  SELECT patient_id, mortality, 'p_model' AS model, p_model AS score FROM cohort
  UNION ALL SELECT patient_id, mortality, 'p_points', p_points FROM cohort)"""
HIST_SQL = """h AS (SELECT model, score, sum(mortality)::BIGINT AS pos, sum(1 - mortality)::BIGINT AS neg
  FROM long GROUP BY ALL)"""
PAIRS_SQL = """auc AS (SELECT model, sum(a.pos * b.neg * CASE WHEN a.score > b.score THEN 1.0
    WHEN a.score = b.score THEN 0.5 ELSE 0 END) / (sum(a.pos * b.neg)) AS auroc
  FROM h a JOIN h b USING (model) GROUP BY model)"""


@query(
    "e1_threshold_metrics",
    with_cohort(
        f""", {LONG_SQL}, c AS (SELECT model, count(*) FILTER (mortality = 1 AND score >= 0.3) AS tp,
        count(*) FILTER (mortality = 0 AND score >= 0.3) AS fp,
        count(*) FILTER (mortality = 1 AND score < 0.3) AS fn,
        count(*) FILTER (mortality = 0 AND score < 0.3) AS tn,
        avg(power(score - mortality, 2)) AS brier FROM long GROUP BY model)
        SELECT model, tp, fp, fn, tn, {r6('brier', 'brier')}, {r6('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')},
        {r6('tp / (tp + fp)', 'precision')}, {r6('tp / (tp + fn)', 'recall')},
        {r6('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))', 'f1')},
        {r6('tn / (tn + fp)', 'specificity')}, {r6('tn / (tn + fn)', 'npv')} FROM c"""
    ),
)
def e1_threshold_metrics(spark, sf_dir):
    return rounded(evaluate.threshold_metrics(both_models(spark, sf_dir), "mortality", "score", 0.3, ["model"]))


@query(
    "e2_auroc",
    with_cohort(
        f""", {LONG_SQL}, {HIST_SQL}, {PAIRS_SQL}
        SELECT model, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
        {r6('max(auroc)', 'auroc')} FROM h JOIN auc USING (model) GROUP BY model"""
    ),
)
def e2_auroc(spark, sf_dir):
    return rounded(evaluate.auroc(both_models(spark, sf_dir), "mortality", "score", ["model"]))


AP_SQL = """ap AS (SELECT a.model, a.score, any_value(a.pos) AS pos,
    sum(b.pos) / sum(b.pos + b.neg) AS precision
  FROM h a JOIN h b ON a.model = b.model AND b.score >= a.score GROUP BY a.model, a.score)"""


@query(
    "e3_auprc",
    with_cohort(
        f""", {LONG_SQL}, {HIST_SQL}, {AP_SQL}
        SELECT model, CAST(sum(pos) AS BIGINT) AS n_pos,
        CAST((SELECT count(*) FROM cohort WHERE mortality = 0) AS BIGINT) AS n_neg,
        {r6('sum(pos * precision) / sum(pos)', 'auprc')} FROM ap GROUP BY model"""
    ),
)
def e3_auprc(spark, sf_dir):
    return rounded(evaluate.average_precision(both_models(spark, sf_dir), "mortality", "score", ["model"]))


@query(
    "e4_regression_metrics",
    f"""SELECT {r6('avg(power(e, 2))', 'mse')}, {r6('sqrt(avg(power(e, 2)))', 'rmse')},
    {r6('avg(abs(e))', 'mae')}, {r6('1 - avg(power(e, 2)) / var_pop(y)', 'r2')},
    {r6('1 - var_pop(e) / var_pop(y)', 'explained_variance')}, {r6('median(abs(e))', 'median_abs_error')}
    FROM (SELECT l_quantity AS y, l_quantity - l_extendedprice / 1500 AS e FROM lineitem)""",
)
def e4_regression_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") / 1500).alias("guess")
    )
    return rounded(evaluate.regression_metrics(lines, "l_quantity", "guess"))


@query(
    "e5_class_report",
    with_cohort(
        f""", p AS (SELECT indice_killip AS a, CASE WHEN presion_arterial_sistolica < 90 THEN 'IV'
            WHEN presion_arterial_sistolica < 110 THEN 'III' WHEN presion_arterial_sistolica < 140 THEN 'II'
            ELSE 'I' END AS p FROM cohort),
        c AS (SELECT k AS class, count(*) FILTER (a = k) AS support, count(*) FILTER (p = k) AS called,
            count(*) FILTER (a = k AND p = k) AS hit
          FROM p, (SELECT unnest(['I', 'II', 'III', 'IV']) AS k) GROUP BY k),
        m AS (SELECT class, support, hit / called AS precision, hit / support AS recall,
            2 * hit / (called + support) AS f1 FROM c)
        SELECT class, CAST(support AS BIGINT) AS support, {r6('precision', 'precision')},
          {r6('recall', 'recall')}, {r6('f1', 'f1')} FROM m
        UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT),
          {r6('sum(precision * support) / sum(support)', 'precision')},
          {r6('sum(recall * support) / sum(support)', 'recall')},
          {r6('sum(f1 * support) / sum(support)', 'f1')} FROM m"""
    ),
)
def e5_class_report(spark, sf_dir):
    pressure = F.col("presion_arterial_sistolica")
    guess = F.when(pressure < 90, "IV").when(pressure < 110, "III").when(pressure < 140, "II").otherwise("I")
    rows = cohort(spark, sf_dir).select("indice_killip", guess.alias("guess"))
    return rounded(evaluate.class_report(rows, "indice_killip", "guess"))


@query(
    "e6_confusion_matrix",
    with_cohort(
        """SELECT mortality AS actual, CAST(p_model >= 0.5 AS INT) AS predicted,
        CAST(count(*) AS BIGINT) AS n FROM cohort GROUP BY ALL"""
    ),
)
def e6_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir), "mortality", "p_model")


@query(
    "e7_roc_points",
    with_cohort(
        f""", {LONG_SQL}, {HIST_SQL}
        SELECT a.model, a.score AS threshold, {r6('sum(b.pos) / any_value(p)', 'tpr')},
          {r6('sum(b.neg) / any_value(q)', 'fpr')}
        FROM h a JOIN h b ON a.model = b.model AND b.score >= a.score
        JOIN (SELECT model, sum(pos) AS p, sum(neg) AS q FROM h GROUP BY model) t ON t.model = a.model
        GROUP BY a.model, a.score"""
    ),
)
def e7_roc_points(spark, sf_dir):
    points = evaluate.roc_points(both_models(spark, sf_dir), "mortality", "score", ["model"])
    return rounded(points.select("model", "threshold", "tpr", "fpr"))


@query(
    "e7_youden",
    with_cohort(
        f""", {LONG_SQL}, {HIST_SQL}, roc AS (
          SELECT a.model, a.score AS threshold, sum(b.pos)::BIGINT AS tp, sum(b.neg)::BIGINT AS fp
          FROM h a JOIN h b ON a.model = b.model AND b.score >= a.score GROUP BY a.model, a.score),
        t AS (SELECT model, sum(pos)::BIGINT AS p, sum(neg)::BIGINT AS q FROM h GROUP BY model),
        best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY tp * q - fp * p DESC, threshold DESC) AS rn
          FROM roc JOIN t USING (model))
        SELECT model, {r6('threshold', 'threshold')}, {r6('tp / p', 'tpr')}, {r6('fp / q', 'fpr')},
          {r6('tp / p - fp / q', 'youden')} FROM best WHERE rn = 1"""
    ),
)
def e7_youden(spark, sf_dir):
    return rounded(evaluate.youden_threshold(both_models(spark, sf_dir), "mortality", "score", ["model"]))


def _calibration_sql(edges: str, column: str) -> str:
    return with_cohort(
        f""", e AS (SELECT list_sort(list_distinct({edges})) AS e FROM cohort),
        b AS (SELECT mortality, {column} AS s,
          len(list_filter(e.e[2:-2], lambda x: {column} > x)) AS bin FROM cohort, e)
        SELECT CAST(bin AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, {r6('avg(s)', 'mean_score')},
          {r6('avg(mortality)', 'event_rate')} FROM b GROUP BY bin"""
    )


_TENTHS = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"


@query("e8_calibration_quantile", _calibration_sql(f"quantile_cont(p_model, {_TENTHS})", "p_model"))
def e8_calibration_quantile(spark, sf_dir):
    return rounded(evaluate.calibration_curve(predictions(spark, sf_dir), "mortality", "p_model"))


@query(
    "e8_calibration_uniform",
    _calibration_sql(f"[x::DOUBLE for x in any_value({_TENTHS})]", "p_model"),
)
def e8_calibration_uniform(spark, sf_dir):
    return rounded(
        evaluate.calibration_curve(predictions(spark, sf_dir), "mortality", "p_model", strategy="uniform")
    )


@query(
    "e9_decision_curve",
    with_cohort(
        f""", t AS (SELECT (2 * i + 1) / 100 AS threshold FROM range(50) r(i))
        SELECT threshold, {r6('sum(mortality * (p_model >= threshold)::INT) / count(*) - sum((1 - mortality) * (p_model >= threshold)::INT) / count(*) * threshold / (1 - threshold)', 'net_benefit')},
        {r6('avg(mortality) - avg(1 - mortality) * threshold / (1 - threshold)', 'treat_all')},
        CAST(0 AS DOUBLE) AS treat_none FROM cohort, t GROUP BY threshold"""
    ),
)
def e9_decision_curve(spark, sf_dir):
    return rounded(evaluate.decision_curve(predictions(spark, sf_dir), "mortality", "p_model"))


@query(
    "e18_diagnostic_metrics",
    with_cohort(
        f""", c AS (SELECT count(*) FILTER (mortality = 1 AND escala_grace >= 140) AS tp,
        count(*) FILTER (mortality = 0 AND escala_grace >= 140) AS fp,
        count(*) FILTER (mortality = 1 AND escala_grace < 140) AS fn,
        count(*) FILTER (mortality = 0 AND escala_grace < 140) AS tn FROM cohort),
        m AS (SELECT *, tp / (tp + fn) AS sens, tn / (tn + fp) AS spec FROM c)
        SELECT tp, fp, fn, tn, {r6('100 * sens', 'sensitivity')}, {r6('100 * spec', 'specificity')},
        {r6('100 * tp / (tp + fp)', 'ppv')}, {r6('100 * tn / (tn + fn)', 'npv')},
        {r6('200 * tp / (2 * tp + fp + fn)', 'f1')}, {r6('sens / (1 - spec)', 'lr_plus')},
        {r6('(1 - sens) / spec', 'lr_minus')} FROM m"""
    ),
)
def e18_diagnostic_metrics(spark, sf_dir):
    return rounded(evaluate.diagnostic_metrics(cohort(spark, sf_dir), "mortality", "escala_grace", 140))


@query(
    "e19_hosmer_lemeshow",
    with_cohort(
        f""", r AS (SELECT mortality AS y, least(greatest(escala_grace / 260, 0), 1) AS p FROM cohort
          WHERE escala_grace IS NOT NULL),
        e AS (SELECT list_sort(list_distinct(quantile_cont(p, {_TENTHS}))) AS e FROM r),
        g AS (SELECT len(list_filter(e.e[2:-2], lambda x: p > x)) AS g, count(*) AS n, sum(y) AS o, sum(p) AS x
          FROM r, e GROUP BY 1)
        SELECT CAST(count(*) AS BIGINT) AS n_groups,
        {r6('sum(CASE WHEN x > 0 AND n > x THEN power(o - x, 2) / (x * (1 - x / n)) END)', 'chi2')},
        CAST(greatest(count(*) - 2, 1) AS BIGINT) AS dof FROM g"""
    ),
)
def e19_hosmer_lemeshow(spark, sf_dir):
    rows = cohort(spark, sf_dir).select(
        "mortality", scores.pseudo_probability("escala_grace", 260).alias("p")
    )
    return rounded(evaluate.hosmer_lemeshow(rows, "mortality", "p").drop("p_value"))


_SUBGROUPS = """d AS (SELECT mortality, unnest([{'dimension': 'infarct', 'level': CAST(scacest AS VARCHAR)},
    {'dimension': 'sex', 'level': sexo}, {'dimension': 'age', 'level':
      CASE WHEN edad < 65 THEN '18-64' WHEN edad < 75 THEN '65-74' ELSE '>=75' END}]) AS l,
    escala_grace, points FROM scored),
  long AS (SELECT l.dimension AS dimension, l.level AS level, 'escala_grace' AS score_name, escala_grace AS s, mortality AS y
    FROM d WHERE escala_grace IS NOT NULL
    UNION ALL SELECT l.dimension, l.level, 'points', points, mortality FROM d),
  h AS (SELECT dimension, level, score_name, s, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM long GROUP BY ALL),
  t AS (SELECT dimension, level, score_name, sum(pos)::BIGINT AS events, sum(pos + neg)::BIGINT AS n FROM h GROUP BY ALL),
  auc AS (SELECT dimension, level, score_name, sum(a.pos * b.neg * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5
      ELSE 0 END) / sum(a.pos * b.neg) AS auroc FROM h a JOIN h b USING (dimension, level, score_name) GROUP BY ALL)"""


@query(
    "e20_subgroup_performance",
    with_cohort(
        f""", scored AS (SELECT *, CAST({PART_SCORE_SQL} AS DOUBLE) AS points FROM cohort), {_SUBGROUPS}
        SELECT dimension, level, score_name, n, events, {r6('100 * events / n', 'event_pct')},
        CASE WHEN n > 50 AND events >= 10 THEN round(auroc, 6) + 0.0 END AS auroc
        FROM t JOIN auc USING (dimension, level, score_name)"""
    ),
)
def e20_subgroup_performance(spark, sf_dir):
    parts = scores.registry_from_parts()
    rows = cohort(spark, sf_dir).withColumn(
        "points", scores.total(list(parts.values())).cast("double")
    )
    dimensions = {"infarct": F.col("scacest"), "sex": F.col("sexo"), "age": bands.age_group("edad")}
    narrow = rows.select(
        "mortality", "escala_grace", "points", *[c.cast("string").alias(f"d_{d}") for d, c in dimensions.items()]
    )
    return rounded(
        evaluate.subgroup_performance(
            narrow, "mortality", ["escala_grace", "points"], {d: F.col(f"d_{d}") for d in dimensions}
        )
    )


@query(
    "e21_event_rate_by_score",
    with_cohort(
        f"""SELECT CAST({TIMI_STEMI_SQL} AS INT) AS value, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(mortality) AS BIGINT) AS events, {r6('avg(mortality)', 'event_rate')}
        FROM cohort GROUP BY 1"""
    ),
)
def e21_event_rate_by_score(spark, sf_dir):
    return rounded(evaluate.event_rate_by(cohort(spark, sf_dir), "mortality", timi_stemi_column()))


@query(
    "e22_cohort_characteristics",
    with_cohort(
        """SELECT stat, round(value, 6) + 0.0 AS value FROM (UNPIVOT (SELECT
        CAST(count(*) AS DOUBLE) AS n_total, CAST(sum(mortality) AS DOUBLE) AS n_events,
        100 * avg(mortality) AS event_pct, avg(edad) AS age_mean, stddev_samp(edad) AS age_sd,
        quantile_cont(edad, 0.25) AS age_q1, quantile_cont(edad, 0.5) AS age_median,
        quantile_cont(edad, 0.75) AS age_q3,
        CAST(count(*) FILTER (sexo = 'masculino') AS DOUBLE) AS n_male,
        100.0 * count(*) FILTER (sexo = 'masculino') / count(*) AS pct_male,
        CAST(count(*) FILTER (scacest = 1) AS DOUBLE) AS n_stemi,
        100.0 * count(*) FILTER (scacest = 1) / count(*) AS pct_stemi FROM cohort)
        ON COLUMNS(*) INTO NAME stat VALUE value)"""
    ),
)
def e22_cohort_characteristics(spark, sf_dir):
    return rounded(
        evaluate.cohort_characteristics(
            cohort(spark, sf_dir), "mortality", "edad",
            {"male": F.col("sexo") == "masculino", "stemi": F.col("scacest") == 1},
        )
    )


@query(
    "d22_event_rate_interval",
    with_cohort(
        f""", g AS (SELECT indice_killip AS value, count(*) AS n, sum(mortality) AS events FROM cohort GROUP BY 1),
        w AS (SELECT *, events / n AS p, 1.959963984540054 AS z FROM g)
        SELECT value, CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events, {r6('p', 'event_rate')},
        {r6('(2 * n * p + z * z - z * sqrt(z * z + 4 * n * p * (1 - p))) / (2 * (n + z * z))', 'ci_low')},
        {r6('(2 * n * p + z * z + z * sqrt(z * z + 4 * n * p * (1 - p))) / (2 * (n + z * z))', 'ci_high')} FROM w"""
    ),
)
def d22_event_rate_interval(spark, sf_dir):
    return rounded(evaluate.event_rate_interval(cohort(spark, sf_dir), "mortality", "indice_killip"))
