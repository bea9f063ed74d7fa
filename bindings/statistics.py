"""Profiles, correlations, association tests and feature ranking."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from bindings.base import cohort, query, r6, rounded, table, with_cohort
from riskloom.functions import bands
from riskloom.operators import association, features, impute, profile

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CLINICAL = ["edad", "creatinina", "filtrado_glomerular", "escala_grace"]


def _profile_sql(rows: str, columns) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS variable, unnest(['count', 'mean', 'std', 'min', 'max', 'q25', 'median', 'q75', 'skewness',
            'kurtosis', 'missing', 'missing_pct']) AS stat, unnest([CAST(count({c}) AS DOUBLE), avg({c}), stddev_samp({c}),
            min({c}), max({c}), quantile_cont({c}, 0.25), median({c}), quantile_cont({c}, 0.75), skewness({c}), kurtosis({c}),
            CAST(count(*) - count({c}) AS DOUBLE), 100.0 * (count(*) - count({c})) / count(*)]) AS value FROM {rows}"""
        )
    return "SELECT variable, stat, round(value, 6) + 0.0 AS value FROM (" + " UNION ALL ".join(parts) + ")"


@query("d1_numeric_profile", _profile_sql("lineitem", _NUMBERS))
def d1_numeric_profile(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query("d1_numeric_profile_gaps", with_cohort(_profile_sql("cohort", _CLINICAL)))
def d1_numeric_profile_gaps(spark, sf_dir):
    return rounded(profile.numeric_profile(cohort(spark, sf_dir).select(*_CLINICAL), _CLINICAL))


_CATEGORIES = ["indice_killip", "complicaciones", "sexo", "tiempo_isquemia"]


@query(
    "d2_categorical_profile",
    with_cohort(
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{c}' AS variable, CAST(sum(n) OVER () AS BIGINT) AS count, CAST(count(*) OVER () AS BIGINT) AS n_categories,
            v AS mode, CAST(n AS BIGINT) AS mode_count FROM (SELECT {c} AS v, count(*) AS n FROM cohort WHERE {c} IS NOT NULL GROUP BY 1)
            ORDER BY n DESC, v LIMIT 1)"""
            for c in _CATEGORIES
        )
    ),
)
def d2_categorical_profile(spark, sf_dir):
    return profile.categorical_profile(cohort(spark, sf_dir).select(*_CATEGORIES), _CATEGORIES)


@query(
    "d2_value_counts",
    """SELECT 'l_returnflag' AS variable, l_returnflag AS value, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, CAST(count(*) AS BIGINT) FROM lineitem GROUP BY 2""",
)
def d2_value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "d3_missing_summary",
    with_cohort(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS variable, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
            {r6(f'(count(*) - count({c})) / count(*)', 'missing_share')} FROM cohort"""
            for c in _CLINICAL + _CATEGORIES
        )
    ),
)
def d3_missing_summary(spark, sf_dir):
    rows = cohort(spark, sf_dir).select(*_CLINICAL, *_CATEGORIES)
    return rounded(profile.missing_summary(rows).drop("dtype"))


@query(
    "d4_class_balance",
    f"""SELECT quality AS value, CAST(count(*) AS BIGINT) AS n, {r6('count(*) / sum(count(*)) OVER ()', 'share')}
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def d4_class_balance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(profile.class_balance(labelled, "quality"))


_AUDITED = ["edad", "creatinina", "filtrado_glomerular", "complicaciones", "v3", "sexo", "escala_grace"]


@query(
    "d5_data_audit",
    with_cohort(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS variable, {r6(f'(count(*) - count({c})) / count(*)', 'missing_share')}, count({c}) = 0 AS all_missing,
            (count(*) - count({c})) / count(*) > 0.8 AS mostly_missing, count(DISTINCT {c}) <= 1 AS constant FROM cohort"""
            for c in _AUDITED
        )
        + ") ORDER BY missing_share DESC, variable LIMIT 5"
    ),
)
def d5_data_audit(spark, sf_dir):
    return rounded(profile.data_audit(cohort(spark, sf_dir).select(*_AUDITED), top=5))


@query(
    "d6_pearson_matrix",
    with_cohort(
        " UNION ALL ".join(
            f"""SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})', 'r')},
            CAST(count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM cohort"""
            for a, b in combinations(_CLINICAL, 2)
        )
    ),
)
def d6_pearson_matrix(spark, sf_dir):
    return rounded(association.pearson_pairs(cohort(spark, sf_dir).select(*_CLINICAL), _CLINICAL))


_DIMENSIONS = 64


@query(
    "d6_pearson_matrix_wide",
    f"""SELECT 'e' || i AS a, 'e' || j AS b, {r6('corr(embedding[i + 1], embedding[j + 1])', 'r')},
    CAST(count(*) FILTER (embedding[i + 1] IS NOT NULL AND embedding[j + 1] IS NOT NULL) AS BIGINT) AS n
    FROM embeddings, range({_DIMENSIONS}) AS p(i), range({_DIMENSIONS}) AS q(j) WHERE i < j GROUP BY i, j""",
)
def d6_pearson_matrix_wide(spark, sf_dir):
    """All pairs of the vector's components as columns, from one scan."""
    names = [f"e{i}" for i in range(_DIMENSIONS)]
    wide = table(spark, sf_dir, "embeddings").select(*[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(names)])
    return rounded(association.pearson_pairs(wide, names))


def _midrank(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"


def _spearman_sql(rows: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, {r6('corr(ra, rb)', 'rho')}, CAST(count(*) AS BIGINT) AS n FROM
      (SELECT {_midrank(a)} AS ra, {_midrank(b)} AS rb FROM {rows} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


_RANKED = ["creatinina", "filtrado_glomerular", "escala_grace"]


@query(
    "d7_spearman_matrix",
    with_cohort(" UNION ALL ".join(_spearman_sql("cohort", a, b) for a, b in combinations(_RANKED, 2))),
)
def d7_spearman_matrix(spark, sf_dir):
    return rounded(association.spearman_pairs(cohort(spark, sf_dir).select(*_RANKED), _RANKED))


def _kendall_sql(rows: str, a: str, b: str) -> str:
    return f"""p AS (SELECT {a} AS x, {b} AS y, count(*) AS w FROM {rows} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
        s AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM p a, p b),
        n AS (SELECT sum(w) AS n FROM p),
        tx AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(w) AS m FROM p GROUP BY x)),
        ty AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(w) AS m FROM p GROUP BY y))
        SELECT '{a}' AS a, '{b}' AS b,
        {r6('s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t))', 'tau')}, CAST(n AS BIGINT) AS n FROM s, n, tx, ty"""


@query("d8_kendall", with_cohort(", " + _kendall_sql("cohort", "edad", "escala_grace")))
def d8_kendall(spark, sf_dir):
    return rounded(association.kendall(cohort(spark, sf_dir).select("edad", "escala_grace"), "edad", "escala_grace"))


@query("d8_kendall_orders", "WITH " + _kendall_sql("orders", "o_totalprice", "o_custkey"))
def d8_kendall_orders(spark, sf_dir):
    """Many distinct values on both axes, one of them with ties."""
    return rounded(association.kendall(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey"))


@query(
    "d9_numeric_test",
    with_cohort(
        f"""SELECT 'edad' AS a, 'escala_grace' AS b, CAST(count(*) AS BIGINT) AS n, {r6('corr(edad, escala_grace)', 'pearson_r')},
        {r6('corr(ra, rb)', 'spearman_r')}, CASE WHEN abs(corr(edad, escala_grace)) < 0.3 THEN 'weak'
          WHEN abs(corr(edad, escala_grace)) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength
        FROM (SELECT edad, escala_grace, {_midrank('edad')} AS ra, {_midrank('escala_grace')} AS rb FROM cohort
          WHERE escala_grace IS NOT NULL)"""
    ),
)
def d9_numeric_test(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("edad", "escala_grace")
    return rounded(
        association.numeric_test(rows, "edad", "escala_grace").drop("pearson_p", "spearman_p", "significant")
    )


@query(
    "d10_anova",
    with_cohort(
        f""", g AS (SELECT indice_killip, count(creatinina) AS n, avg(creatinina) AS m, var_samp(creatinina) AS v FROM cohort GROUP BY 1),
        t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
        SELECT 'creatinina' AS numeric, 'indice_killip' AS category, CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(n) AS BIGINT) AS n,
        {r6('(sum(n * power(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*)))', 'f_statistic')} FROM g, t"""
    ),
)
def d10_anova(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("creatinina", "indice_killip")
    return rounded(association.anova_test(rows, "creatinina", "indice_killip").drop("p_value", "significant"))


def _chi2_sql(a: str, b: str, corrected: bool) -> str:
    off = "power(greatest(abs(o - e) - 0.5, 0), 2) / e" if corrected else "power(o - e, 2) / e"
    return with_cohort(
        f""", x AS (SELECT CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM cohort WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
        r AS (SELECT x, count(*) AS rx FROM x GROUP BY 1), c AS (SELECT y, count(*) AS cy FROM x GROUP BY 1),
        o AS (SELECT x, y, count(*) AS o FROM x GROUP BY ALL), n AS (SELECT count(*) AS n FROM x),
        t AS (SELECT coalesce(o.o, 0) AS o, rx * cy / n AS e, n, (SELECT count(*) FROM r) AS k, (SELECT count(*) FROM c) AS l
          FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.x = r.x AND o.y = c.y)
        SELECT '{a}' AS a, '{b}' AS b, CAST(any_value(n) AS BIGINT) AS n, {r6(f'sum({off})', 'chi2')},
        CAST((any_value(k) - 1) * (any_value(l) - 1) AS BIGINT) AS dof,
        {r6(f'sqrt(sum({off}) / (any_value(n) * (least(any_value(k), any_value(l)) - 1)))', 'cramers_v')} FROM t"""
    )


@query("d11_chi2", _chi2_sql("indice_killip", "complicaciones", False))
def d11_chi2(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("indice_killip", "complicaciones")
    return rounded(association.chi2_test(rows, "indice_killip", "complicaciones").drop("p_value", "strength", "significant"))


@query("d11_chi2_2x2", _chi2_sql("sexo", "mortality", True))
def d11_chi2_2x2(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("sexo", "mortality")
    return rounded(association.chi2_test(rows, "sexo", "mortality").drop("p_value", "strength", "significant"))


@query(
    "d12_pair_dispatch",
    with_cohort(
        f""", g AS (SELECT sexo, count(edad) AS n, avg(edad) AS m, var_samp(edad) AS v FROM cohort GROUP BY 1),
        t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
        SELECT 'edad' AS a, 'creatinina' AS b, 'correlation' AS test, {r6('corr(edad, creatinina)', 'statistic')} FROM cohort
        UNION ALL SELECT 'sexo', 'edad', 'anova',
        {r6('(sum(n * power(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*)))', 'statistic')} FROM g, t"""
    ),
)
def d12_pair_dispatch(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("edad", "creatinina", "sexo")
    numeric = ["edad", "creatinina"]
    tests = association.pair_test(rows, "edad", "creatinina", numeric).unionByName(
        association.pair_test(rows, "sexo", "edad", numeric)
    )
    return rounded(tests.select("a", "b", "test", "statistic"))


@query(
    "d15_eda_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS INT) AS n_columns, CAST(4 AS INT) AS n_numeric, CAST(2 AS INT) AS n_categorical,
    CAST(6 * count(*) - count(l_quantity) - count(l_extendedprice) - count(l_discount) - count(l_tax) - count(l_returnflag) - count(l_linestatus) AS BIGINT) AS missing_cells,
    {r6('((abs(skewness(l_quantity)) > 1)::INT + (abs(skewness(l_extendedprice)) > 1)::INT + (abs(skewness(l_discount)) > 1)::INT + (abs(skewness(l_tax)) > 1)::INT) / 4.0', 'skewed_share')} FROM lineitem""",
)
def d15_eda_summary(spark, sf_dir):
    return rounded(
        association.eda_summary(table(spark, sf_dir, "lineitem"), _NUMBERS, ["l_returnflag", "l_linestatus"])
    )


@query(
    "d16_histogram",
    f"""SELECT CAST(bin AS INT) AS bin, {r6('any_value(lo) + bin * any_value(w)', 'low')}, {r6('any_value(lo) + (bin + 1) * any_value(w)', 'high')},
    CAST(count(*) AS BIGINT) AS n FROM (SELECT least(floor((l_extendedprice - lo) / w), 29) AS bin, lo, w FROM lineitem,
      (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)) GROUP BY bin""",
)
def d16_histogram(spark, sf_dir):
    return rounded(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query(
    "d16_box_numbers",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, {r6(f'min({c})', 'low')}, {r6(f'quantile_cont({c}, 0.25)', 'q25')}, {r6(f'median({c})', 'median')},
        {r6(f'quantile_cont({c}, 0.75)', 'q75')}, {r6(f'max({c})', 'high')} FROM lineitem"""
        for c in _NUMBERS
    ),
)
def d16_box_numbers(spark, sf_dir):
    return rounded(profile.box_numbers(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query(
    "d16_top_categories",
    """SELECT 'p_brand' AS variable, p_brand AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand
    ORDER BY n DESC, p_brand LIMIT 20""",
)
def d16_top_categories(spark, sf_dir):
    return profile.top_categories(table(spark, sf_dir, "part"), "p_brand")


@query(
    "d17_trend_line",
    f"""SELECT {r6('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {r6('regr_intercept(l_extendedprice, l_quantity)', 'intercept')},
    {r6('regr_r2(l_extendedprice, l_quantity)', 'r2')}, CAST(count(*) AS BIGINT) AS n FROM lineitem""",
)
def d17_trend_line(spark, sf_dir):
    return rounded(association.trend_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


_BAND = "CASE WHEN edad <= 50 THEN '(0,50]' WHEN edad <= 60 THEN '(50,60]' WHEN edad <= 70 THEN '(60,70]' WHEN edad <= 80 THEN '(70,80]' ELSE '(80,120]' END"


@query(
    "d20_drift_check",
    with_cohort(
        f""", v AS (SELECT 'before' AS version, * FROM cohort UNION ALL SELECT 'after', * FROM cohort WHERE creatinina IS NOT NULL),
        w AS (SELECT version, 'all' AS band, unnest(['n', 'target_rate', 'age_mean', 'age_sd', 'age_target_r', 'distinct_rows']) AS stat,
          unnest([CAST(count(*) AS DOUBLE), avg(mortality), avg(edad), stddev_samp(edad), corr(edad, mortality),
            CAST(count(DISTINCT (edad, mortality)) AS DOUBLE)]) AS value FROM v GROUP BY version
          UNION ALL SELECT version, {_BAND}, unnest(['n', 'target_rate']), unnest([CAST(count(*) AS DOUBLE), avg(mortality)])
          FROM v GROUP BY version, {_BAND})
        SELECT version, band, stat, round(value, 6) + 0.0 AS value FROM w"""
    ),
)
def d20_drift_check(spark, sf_dir):
    before = cohort(spark, sf_dir)
    after = cohort(spark, sf_dir).filter(F.col("creatinina").isNotNull())
    return rounded(
        association.drift_check(before, after, "mortality", "edad", bands.age_band("edad"), "patient_id")
    )


@query(
    "d21_outcome_comparison",
    with_cohort(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS variable, mortality AS outcome, CAST(NULL AS VARCHAR) AS level, CAST(count({c}) AS BIGINT) AS n, {r6(f'avg({c})', 'mean')},
            {r6(f'stddev_samp({c})', 'sd')}, {r6(f'quantile_cont({c}, 0.25)', 'q25')}, {r6(f'median({c})', 'median')},
            {r6(f'quantile_cont({c}, 0.75)', 'q75')}, {r6(f'min({c})', 'low')}, {r6(f'max({c})', 'high')}, CAST(NULL AS DOUBLE) AS pct
            FROM cohort GROUP BY mortality"""
            for c in ("edad", "creatinina")
        )
        + f""" UNION ALL SELECT 'indice_killip', mortality, indice_killip, CAST(count(*) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY mortality), 6) FROM cohort GROUP BY mortality, indice_killip"""
    ),
)
def d21_outcome_comparison(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("mortality", "edad", "creatinina", "indice_killip")
    compared = association.outcome_comparison(rows, "mortality", ["edad", "creatinina"], ["indice_killip"])
    return rounded(compared.drop("p_value"))


_FEATURES = ["edad", "creatinina", "presion_arterial_sistolica", "frecuencia_cardiaca", "filtrado_glomerular", "diabetes_mellitus"]


@query(
    "f1_target_ranking",
    with_cohort(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS variable, {r6(f'abs(corr({c}, mortality))', 'r')}, CAST(count({c}) AS BIGINT) AS n,
            {r6(f'1 - count({c}) / count(*)', 'missing_share')} FROM cohort"""
            for c in _FEATURES
        )
    ),
)
def f1_target_ranking(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("mortality", *_FEATURES)
    return rounded(features.target_ranking(rows, "mortality", _FEATURES).drop("p_value"))


# The two-sided tail of Student's t is an integral of a power of the cosine, here summed by Simpson's rule.
@query(
    "f2_usable_features",
    with_cohort(
        ", steps AS (SELECT unnest(generate_series(0, 20000)) AS j), facts AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS variable, abs(corr({c}, mortality)) AS r, count({c}) AS n, 1 - count({c}) / count(*) AS missing_share FROM cohort"
            for c in _FEATURES
        )
        + f"""), tails AS (SELECT variable, r, n, missing_share, n - 2 AS dof, atan(r / sqrt(1 - r * r)) AS angle FROM facts WHERE n >= 100),
        tested AS (SELECT variable, r, n, missing_share, sum(w * pow(cos(angle + (pi() / 2 - angle) * j / 20000), dof - 1)) * (pi() / 2 - angle)
            / sum(w * pow(cos(pi() / 2 * j / 20000), dof - 1)) / (pi() / 2) AS p
          FROM tails, (SELECT j, CASE WHEN j % 20000 = 0 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS w FROM steps) GROUP BY variable, r, n, missing_share, angle, dof)
        SELECT variable, {r6('r', 'r')}, CAST(n AS BIGINT) AS n, {r6('missing_share', 'missing_share')}, {r6('p', 'p_value')}
        FROM tested WHERE p < 0.05 AND missing_share < 0.3"""
    ),
)
def f2_usable_features(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("mortality", *_FEATURES)
    return rounded(features.usable_features(features.target_ranking(rows, "mortality", _FEATURES)))


_DERIVED = {
    "edad": "edad",
    "meses": "edad * 12 + creatinina",
    "presion": "presion_arterial_sistolica",
    "presion2": "presion_arterial_sistolica * 2 + 1",
    "creatinina": "creatinina",
}


@query(
    "f6_correlated_removal",
    with_cohort(
        f""", t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _DERIVED.items())} FROM cohort)
        SELECT DISTINCT b AS variable FROM ("""
        + " UNION ALL ".join(
            f"SELECT '{b}' AS b, corr({a}, {b}) AS r FROM t" for a, b in combinations(_DERIVED, 2)
        )
        + ") WHERE abs(r) > 0.9"
    ),
)
def f6_correlated_removal(spark, sf_dir):
    rows = cohort(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in _DERIVED.items()])
    dropped = features.correlated_columns(rows, list(_DERIVED))
    return spark.createDataFrame([(c,) for c in dropped], "variable string")


@query(
    "f7_low_variance",
    with_cohort(
        ", v AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS variable, var_samp({c}) AS variance FROM cohort" for c in _FEATURES)
        + f") SELECT variable, {r6('variance', 'variance')} FROM v WHERE variance < (SELECT quantile_cont(variance, 0.05) FROM v)"
    ),
)
def f7_low_variance(spark, sf_dir):
    return rounded(features.low_variance_columns(cohort(spark, sf_dir).select(*_FEATURES), _FEATURES))


@query(
    "f8_missing_indicators",
    with_cohort(
        f"""SELECT patient_id, {r6('coalesce(creatinina, (SELECT median(creatinina) FROM cohort))', 'creatinina')},
        CAST(creatinina IS NULL AS INT) AS creatinina_missing FROM cohort"""
    ),
)
def f8_missing_indicators(spark, sf_dir):
    rows = impute.missing_indicators(cohort(spark, sf_dir).select("patient_id", "creatinina"), ["creatinina"])
    return rounded(impute.apply_fills(rows, impute.fit_fills(rows, {"creatinina": "median"})))
