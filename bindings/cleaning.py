"""Cleaning operators: outliers on lineitem and the cohort, fills, bins, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import cohort, query, r6, rounded, table, with_cohort
from riskloom.operators import binning, encode, impute
from riskloom.operators.outliers import OutlierRule, fit_outliers
from riskloom.operators.profile import column_facts, facts_table
from riskloom.plans import cleaning

_MIXED = ["edad", "frecuencia_cardiaca", "creatinina", "indice_killip", "diabetes_mellitus", "v1", "peso"]


def _kind_sql(column: str, numeric_type: bool) -> str:
    kind = (
        f"CASE WHEN count(DISTINCT {column}) <= 10 AND count({column}) > 0 THEN 'categorical' ELSE 'numeric' END"
        if numeric_type
        else "'categorical'"
    )
    return f"""SELECT '{column}' AS variable, {kind} AS kind, CAST(count(*) AS BIGINT) AS n,
      CAST(count(*) - count({column}) AS BIGINT) AS n_missing FROM cohort"""


@query(
    "c1_column_kinds",
    with_cohort(
        " UNION ALL ".join(_kind_sql(c, c not in ("indice_killip", "peso")) for c in _MIXED)
    ),
)
def c1_column_kinds(spark, sf_dir):
    rows = cohort(spark, sf_dir).select(*_MIXED)
    return facts_table(rows, column_facts(rows)).drop("dtype")


_RARE = "CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE 'y' END"


@query(
    "c2_c3_c4_drop_columns",
    f"""WITH t AS (SELECT o_totalprice, o_orderstatus, {_RARE} AS rare, CAST(NULL AS DOUBLE) AS empty FROM orders),
    s AS (SELECT 'rare' AS variable, max(n) / sum(n) AS share FROM (SELECT rare AS v, count(*) AS n FROM t GROUP BY 1)
      UNION ALL SELECT 'o_totalprice', max(n) / sum(n) FROM (SELECT o_totalprice AS v, count(*) AS n FROM t GROUP BY 1)
      UNION ALL SELECT 'o_orderstatus', max(n) / sum(n) FROM (SELECT o_orderstatus AS v, count(*) AS n FROM t GROUP BY 1))
    SELECT variable, 'nearly_constant' AS reason FROM s WHERE share >= 0.95
    UNION ALL SELECT 'empty', 'fully_missing' FROM t HAVING count(empty) = 0
    UNION ALL SELECT 'o_orderkey', 'dropped_by_user'""",
)
def c2_c3_c4_drop_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.expr(_RARE).alias("rare"),
        F.lit(None).cast("double").alias("empty"),
    )
    config = cleaning.CleaningConfig(columns_to_drop=["o_orderkey"])
    removed = cleaning.columns_to_remove(column_facts(rows), config, [])
    return spark.createDataFrame(list(removed.items()), "variable string, reason string")


@query(
    "c5_drop_duplicates",
    """SELECT l_returnflag, l_linestatus, l_quantity, l_discount, min(l_orderkey) AS first_order
    FROM lineitem GROUP BY ALL""",
)
def c5_drop_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_discount", F.col("l_orderkey").alias("first_order")
    )
    return cleaning.drop_duplicate_rows(rows, "first_order")


_PRICE = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_PRICE)


def _bounds_sql(rows: str, columns, fit: str, low: str, high: str, method: str) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS variable, '{method}' AS method, {r6('any_value(lo)', 'low')}, {r6('any_value(hi)', 'high')},
            CAST(count(*) FILTER (x < lo OR x > hi) AS BIGINT) AS n_outliers
            FROM (SELECT {c} AS x FROM {rows}), (SELECT {low} AS lo, {high} AS hi FROM
              (SELECT {fit.format(c=c)} FROM {rows}))"""
        )
    return " UNION ALL ".join(parts)


_IQR_FIT = "quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b"


@query(
    "c6_iqr_bounds",
    _bounds_sql("lineitem", _PRICE, _IQR_FIT, "a - 1.5 * (b - a)", "b + 1.5 * (b - a)", "iqr"),
)
def c6_iqr_bounds(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    model = fit_outliers(lines, {c: OutlierRule("iqr", "none") for c in _PRICE})
    return rounded(model.bounds_table(lines).drop("treatment"))


@query(
    "c7_zscore",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, CAST(count(*) FILTER (abs((x - m) / s) > 1.7) AS BIGINT) AS n_outliers
        FROM (SELECT {c} AS x FROM lineitem), (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)"""
        for c in _PRICE
    ),
)
def c7_zscore(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    rule = OutlierRule("zscore", "none", zscore_threshold=1.7)
    return fit_outliers(lines, {c: rule for c in _PRICE}).bounds_table(lines).select("variable", "n_outliers")


@query(
    "c8_modified_zscore",
    with_cohort(
        f"""SELECT 'creatinina' AS variable, 'modified_zscore' AS method,
        {r6('any_value(med - 1.1 * mad / 0.6745)', 'low')}, {r6('any_value(med + 1.1 * mad / 0.6745)', 'high')},
        CAST(count(*) FILTER (abs(0.6745 * (x - med) / mad) > 1.1) AS BIGINT) AS n_outliers
        FROM (SELECT creatinina AS x FROM cohort), (SELECT median(creatinina) AS med, mad(creatinina) AS mad FROM cohort)"""
    ),
)
def c8_modified_zscore(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("creatinina")
    rule = OutlierRule("modified_zscore", "none", modified_zscore_threshold=1.1)
    return rounded(fit_outliers(rows, {"creatinina": rule}).bounds_table(rows).drop("treatment"))


@query(
    "c9_percentile",
    _bounds_sql("lineitem", _PRICE, "quantile_cont({c}, 0.01) AS a, quantile_cont({c}, 0.99) AS b", "a", "b", "percentile"),
)
def c9_percentile(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    model = fit_outliers(lines, {c: OutlierRule("percentile", "none") for c in _PRICE})
    return rounded(model.bounds_table(lines).drop("treatment"))


@query(
    "c12_cap",
    f"""SELECT l_orderkey, l_linenumber, {r6('least(greatest(l_quantity, lo), hi)', 'l_quantity')}
    FROM lineitem, (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem)""",
)
def c12_cap(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    rule = OutlierRule("percentile", "cap", lower_percentile=5, upper_percentile=95)
    return rounded(fit_outliers(lines, {"l_quantity": rule}).transform(lines))


@query(
    "c12_cap_zscore",
    with_cohort(
        f"""SELECT patient_id, {r6('''CASE WHEN abs((x - m) / s) > 1.5 AND x < lo THEN lo
          WHEN abs((x - m) / s) > 1.5 AND x > hi THEN hi ELSE x END''', 'edad')}
        FROM (SELECT patient_id, edad AS x FROM cohort), (SELECT avg(edad) AS m, stddev_pop(edad) AS s,
          quantile_cont(edad, 0.01) AS lo, quantile_cont(edad, 0.99) AS hi FROM cohort)"""
    ),
)
def c12_cap_zscore(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "edad")
    rule = OutlierRule("zscore", "cap", zscore_threshold=1.5)
    return rounded(fit_outliers(rows, {"edad": rule}).transform(rows))


@query(
    "c13_remove",
    with_cohort(
        f"""SELECT patient_id, CASE WHEN x BETWEEN lo AND hi THEN round(x, 6) + 0.0 END AS creatinina
        FROM (SELECT patient_id, creatinina AS x FROM cohort),
        (SELECT quantile_cont(creatinina, 0.01) AS lo, quantile_cont(creatinina, 0.99) AS hi FROM cohort)"""
    ),
)
def c13_remove(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "creatinina")
    return rounded(fit_outliers(rows, {"creatinina": OutlierRule("percentile", "remove")}).transform(rows))


@query(
    "c14_transform",
    with_cohort(
        f"""SELECT patient_id, {r6('ln(1 + edad)', 'edad')},
        {r6('sqrt(creatinina - (SELECT min(creatinina) FROM cohort) + 1)', 'creatinina')},
        {r6('sqrt(filtrado_glomerular)', 'filtrado_glomerular')} FROM cohort"""
    ),
)
def c14_transform(spark, sf_dir):
    columns = ["edad", "creatinina", "filtrado_glomerular"]
    rows = cohort(spark, sf_dir).select("patient_id", *columns)
    return rounded(fit_outliers(rows, {c: OutlierRule("iqr", "transform") for c in columns}).transform(rows))


@query(
    "c15_outlier_dispatch",
    with_cohort(
        f"""SELECT 'edad' AS variable, 'iqr' AS method, 'cap' AS treatment, CAST(count(*) FILTER
          (edad < a - 0.2 * (b - a) OR edad > b + 0.2 * (b - a)) AS BIGINT) AS n_outliers
        FROM cohort, (SELECT quantile_cont(edad, 0.25) AS a, quantile_cont(edad, 0.75) AS b FROM cohort)
        UNION ALL SELECT 'creatinina', 'percentile', 'remove', CAST(count(*) FILTER (creatinina < a OR creatinina > b) AS BIGINT)
        FROM cohort, (SELECT quantile_cont(creatinina, 0.01) AS a, quantile_cont(creatinina, 0.99) AS b FROM cohort)
        UNION ALL SELECT 'frecuencia_cardiaca', 'zscore', 'none',
          CAST(count(*) FILTER (abs((frecuencia_cardiaca - m) / s) > 1.6) AS BIGINT)
        FROM cohort, (SELECT avg(frecuencia_cardiaca) AS m, stddev_pop(frecuencia_cardiaca) AS s FROM cohort)"""
    ),
)
def c15_outlier_dispatch(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("edad", "creatinina", "frecuencia_cardiaca")
    rules = {
        "edad": OutlierRule("iqr", "cap", iqr_multiplier=0.2),
        "creatinina": OutlierRule("percentile", "remove"),
        "frecuencia_cardiaca": OutlierRule("zscore", "none", zscore_threshold=1.6),
    }
    return fit_outliers(rows, rules).bounds_table(rows).drop("low", "high")


@query(
    "c16_fill_mean_median_constant",
    with_cohort(
        f"""SELECT patient_id, {r6('coalesce(creatinina, (SELECT avg(creatinina) FROM cohort))', 'creatinina')},
        {r6('coalesce(filtrado_glomerular, (SELECT median(filtrado_glomerular) FROM cohort))', 'filtrado_glomerular')},
        {r6('coalesce(escala_grace, -1)', 'escala_grace')} FROM cohort"""
    ),
)
def c16_fill_mean_median_constant(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "creatinina", "filtrado_glomerular", "escala_grace")
    fills = impute.fit_fills(
        rows, {"creatinina": "mean", "filtrado_glomerular": "median", "escala_grace": "constant"},
        {"escala_grace": -1.0},
    )
    return rounded(impute.apply_fills(rows, fills))


def _mode_sql(column: str) -> str:
    return f"(SELECT {column} FROM cohort WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "c17_fill_mode",
    with_cohort(
        f"""SELECT patient_id, coalesce(complicaciones, {_mode_sql('complicaciones')}) AS complicaciones,
        coalesce(v1, {_mode_sql('v1')}) AS v1, coalesce(tiempo_isquemia, {_mode_sql('tiempo_isquemia')}) AS tiempo_isquemia
        FROM cohort"""
    ),
)
def c17_fill_mode(spark, sf_dir):
    columns = ["complicaciones", "v1", "tiempo_isquemia"]
    rows = cohort(spark, sf_dir).select("patient_id", *columns)
    return impute.apply_fills(rows, impute.fit_fills(rows, {c: "mode" for c in columns}))


@query(
    "c18_forward_fill",
    with_cohort(
        f"""SELECT patient_id, {r6('''coalesce(last_value(creatinina IGNORE NULLS) OVER (ORDER BY patient_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), (SELECT median(creatinina) FROM cohort))''', 'creatinina')}
        FROM cohort"""
    ),
)
def c18_forward_fill(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "creatinina")
    fallback = impute.fit_fills(rows, {"creatinina": "forward"})
    return rounded(impute.fill_ordered(rows, ["creatinina"], "patient_id", fallback=fallback))


_GAPPY = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


@query(
    "c18_backward_fill_by_user",
    f"""SELECT event_id, user_id, {r6('''first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)''', 'value')}
    FROM (SELECT event_id, user_id, {_GAPPY} AS v FROM events)""",
)
def c18_backward_fill_by_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_GAPPY).alias("value"))
    return rounded(impute.fill_ordered(rows, ["value"], "event_id", by=["user_id"], backward=True))


def _label_sql(edges: str, column: str, rows: str, key: str) -> str:
    """Left-closed bins with printed labels, from a list of edges."""
    return f"""WITH e AS (SELECT {edges} AS e FROM {rows}), b AS (SELECT {key}, {column} AS x, e.e AS e,
        least(greatest(len(list_filter(e.e, lambda v: v <= {column})), 1), len(e.e) - 1) AS i FROM {rows}, e)
      SELECT {key}, CASE WHEN x IS NULL THEN NULL ELSE (CASE WHEN i = 1 THEN '[' ELSE '(' END)
        || printf('%.2f', e[i]) || ', ' || printf('%.2f', e[i + 1]) || ']' END AS {column} FROM b"""


@query(
    "c21_bins_uniform",
    f"""SELECT bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN i = 0 THEN '[' ELSE '(' END
      || printf('%.2f', lo + (hi - lo) * i / 5) || ', ' || printf('%.2f', lo + (hi - lo) * (i + 1) / 5) || ']' AS bin
      FROM (SELECT lo, hi, least(floor((l_quantity - lo) / ((hi - lo) / 5)), 4) AS i
        FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem))) GROUP BY 1""",
)
def c21_bins_uniform(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_quantity")
    bins = binning.fit_bins(lines, "l_quantity", "uniform", 5)
    return lines.select(bins.label().alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query(
    "c21_bins_quantile",
    _label_sql(
        "list_sort(list_distinct(quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))",
        "l_extendedprice", "lineitem", "l_orderkey, l_linenumber",
    ),
)
def c21_bins_quantile(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return binning.apply_bins(lines, [binning.fit_bins(lines, "l_extendedprice", "quantile", 5)])


@query("c22_bins_kmeans")
def c22_bins_kmeans(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_extendedprice")
    bins = binning.fit_bins(lines, "l_extendedprice", "kmeans", 5)
    return binning.bin_summary(lines, bins)


@query(
    "c23_bins_custom",
    with_cohort(
        """SELECT patient_id, CASE WHEN creatinina >= 0.5 AND creatinina <= 1 THEN 'low'
        WHEN creatinina > 1 AND creatinina <= 2 THEN 'middle' WHEN creatinina > 2 AND creatinina <= 4 THEN 'high'
        END AS creatinina FROM cohort"""
    ),
)
def c23_bins_custom(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "creatinina")
    bins = binning.fit_bins(
        rows, "creatinina", "custom", edges=[0.5, 1, 2, 4], labels=["low", "middle", "high"]
    )
    return binning.apply_bins(rows, [bins])


@query(
    "c24_bin_summary",
    with_cohort(
        """SELECT CASE WHEN creatinina >= 0 AND creatinina <= 1 THEN 'bin_0' WHEN creatinina > 1 AND creatinina <= 2
        THEN 'bin_1' WHEN creatinina > 2 AND creatinina <= 5 THEN 'bin_2' ELSE 'missing' END AS label,
        CAST(count(*) AS BIGINT) AS n FROM cohort GROUP BY 1"""
    ),
)
def c24_bin_summary(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("creatinina")
    return binning.bin_summary(rows, binning.fit_bins(rows, "creatinina", "custom", edges=[0, 1, 2, 5]))


@query(
    "c25_encode_label",
    with_cohort(
        """, m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
          (SELECT DISTINCT coalesce(tiempo_isquemia, 'nan') AS v FROM cohort))
        SELECT patient_id, CAST(code AS INT) AS tiempo_isquemia FROM cohort
        JOIN m ON v = coalesce(tiempo_isquemia, 'nan')"""
    ),
)
def c25_encode_label(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "tiempo_isquemia")
    return encode.encode_labels(rows, "tiempo_isquemia", encode.fit_labels(rows, "tiempo_isquemia"))


@query(
    "c26_encode_ordinal",
    with_cohort(
        """SELECT patient_id, CAST(CASE indice_killip WHEN 'I' THEN 0 WHEN 'II' THEN 1 WHEN 'III' THEN 2
        ELSE -1 END AS INT) AS indice_killip FROM cohort"""
    ),
)
def c26_encode_ordinal(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "indice_killip")
    return rows.withColumn("indice_killip", encode.ordinal_code("indice_killip", ["I", "II", "III"]))


@query(
    "c27_encode_one_hot",
    with_cohort(
        """SELECT patient_id, (indice_killip = 'II')::INT AS "indice_killip_II",
        (indice_killip = 'III')::INT AS "indice_killip_III", (indice_killip = 'IV')::INT AS "indice_killip_IV"
        FROM cohort"""
    ),
)
def c27_encode_one_hot(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("patient_id", "indice_killip")
    return encode.encode_one_hot(rows, "indice_killip", encode.fit_one_hot(rows, "indice_killip"), drop_first=True)


@query(
    "c28_retype_numeric",
    with_cohort(
        f"SELECT patient_id, {r6('CAST(tiempo_isquemia AS DOUBLE)', 'tiempo_isquemia')}, peso FROM cohort"
    ),
)
def c28_retype_numeric(spark, sf_dir):
    return rounded(encode.retype_numeric(cohort(spark, sf_dir).select("patient_id", "tiempo_isquemia", "peso")))


_CLEAN = ["patient_id", "edad", "creatinina", "filtrado_glomerular", "indice_killip", "complicaciones", "mortality"]


def _cleaned(spark, sf_dir):
    rows = cohort(spark, sf_dir).select(*_CLEAN)
    config = cleaning.CleaningConfig(
        numeric_imputation="median", outliers=OutlierRule("percentile", "cap"),
        custom_encoding={"indice_killip": "ordinal"},
        ordinal_categories={"indice_killip": ["I", "II", "III", "IV"]},
    )
    model, cleaned = cleaning.fit_cleaning(rows, config, "mortality", "patient_id")
    return rows, model, cleaned


@query(
    "c29_variable_metadata",
    with_cohort(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS variable, 'numeric' AS kind, CAST(count(*) FILTER ({c} < lo OR {c} > hi) AS BIGINT) AS outliers_treated,
            'none' AS encoding, true AS imputed, {r6(f'min({c})', 'min_before')}, {r6(f'max({c})', 'max_before')},
            {r6('any_value(lo)', 'min_after')}, {r6('any_value(hi)', 'max_after')},
            CAST(count(*) - count({c}) AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after
            FROM cohort, (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM cohort)"""
            for c in ("edad", "creatinina", "filtrado_glomerular")
        )
        + """ UNION ALL SELECT 'indice_killip', 'categorical', 0, 'ordinal', false, NULL, NULL, 0, 3, 0, 0
        UNION ALL SELECT 'complicaciones', 'categorical', 0, 'label', false, NULL, NULL, 0,
          count(DISTINCT complicaciones), count(*) - count(complicaciones), 0 FROM cohort"""
    ),
)
def c29_variable_metadata(spark, sf_dir):
    rows, model, cleaned = _cleaned(spark, sf_dir)
    metadata = cleaning.variable_metadata(rows, cleaned, model)
    return rounded(
        metadata.select(
            "variable", "kind", "outliers_treated", "encoding", "imputed", "min_before", "max_before",
            "min_after", "max_after", "missing_before", "missing_after",
        )
    )


@query(
    "c29_cleaning_report",
    with_cohort(
        """, o AS (SELECT sum(n) AS n FROM (
          SELECT count(*) FILTER (edad < lo OR edad > hi) AS n FROM cohort, (SELECT quantile_cont(edad, 0.01) AS lo, quantile_cont(edad, 0.99) AS hi FROM cohort)
          UNION ALL SELECT count(*) FILTER (creatinina < lo OR creatinina > hi) FROM cohort, (SELECT quantile_cont(creatinina, 0.01) AS lo, quantile_cont(creatinina, 0.99) AS hi FROM cohort)
          UNION ALL SELECT count(*) FILTER (filtrado_glomerular < lo OR filtrado_glomerular > hi) FROM cohort, (SELECT quantile_cont(filtrado_glomerular, 0.01) AS lo, quantile_cont(filtrado_glomerular, 0.99) AS hi FROM cohort)))
        SELECT CAST(5 AS BIGINT) AS n_variables, CAST(3 AS BIGINT) AS n_imputed, CAST(2 AS BIGINT) AS n_encoded,
        CAST(any_value(o.n) AS BIGINT) AS outliers_treated,
        CAST(count(*) * 3 - count(creatinina) - count(filtrado_glomerular) - count(complicaciones) AS BIGINT) AS missing_before
        FROM cohort, o"""
    ),
)
def c29_cleaning_report(spark, sf_dir):
    rows, model, cleaned = _cleaned(spark, sf_dir)
    report = cleaning.cleaning_report(cleaning.variable_metadata(rows, cleaned, model))
    return report.select("n_variables", "n_imputed", "n_encoded", "outliers_treated", "missing_before")
