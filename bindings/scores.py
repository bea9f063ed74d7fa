"""Point scores and bands on the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import cohort, query, r6, rounded, with_cohort
from riskloom.functions import bands, scores
from riskloom.functions import fixed_values as fv


def grace_column(contiguous: bool = False):
    return scores.grace_score(
        "edad", "frecuencia_cardiaca", "presion_arterial_sistolica", "creatinina",
        F.col("paro_cardiaco") == 1, F.col("depresion_st") == 1, F.lit(False),
        scores.killip_number("indice_killip"), contiguous,
    )


def _case(column: str, table, contiguous: bool = False) -> str:
    arms = []
    for i, (low, high, points) in enumerate(table):
        end = table[i + 1][0] if contiguous and i + 1 < len(table) else high
        arms.append(f"WHEN {column} >= {low} AND {column} < {end} THEN {points}")
    return f"CASE {' '.join(arms)} ELSE 0 END"


def grace_sql(contiguous: bool = False) -> str:
    return f"""(
      {_case('edad', fv.GRACE_AGE, contiguous)}
      + {_case('frecuencia_cardiaca', fv.GRACE_HEART_RATE, contiguous)}
      + {_case('presion_arterial_sistolica', fv.GRACE_SYSTOLIC, contiguous)}
      + {_case('creatinina', fv.GRACE_CREATININE, contiguous)}
      + CASE WHEN paro_cardiaco = 1 THEN 43 ELSE 0 END
      + CASE WHEN depresion_st = 1 THEN 30 ELSE 0 END
      + CASE indice_killip WHEN 'II' THEN 21 WHEN 'III' THEN 43 WHEN 'IV' THEN 43 ELSE 0 END)"""


GRACE_BAND_SQL = "CASE WHEN grace <= 108 THEN 'low' WHEN grace <= 140 THEN 'intermediate' ELSE 'high' END"


@query(
    "k1_grace",
    with_cohort(
        f"""SELECT patient_id, CAST(grace AS INT) AS grace, {GRACE_BAND_SQL} AS band
        FROM (SELECT patient_id, {grace_sql()} AS grace FROM cohort)"""
    ),
)
def k1_grace(spark, sf_dir):
    scored = cohort(spark, sf_dir).select("patient_id", grace_column().alias("grace"))
    return scored.withColumn("band", scores.grace_band(F.col("grace")))


@query(
    "k1_grace_contiguous",
    with_cohort(
        f"""SELECT CAST(grace AS INT) AS grace, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT {grace_sql(True)} AS grace FROM cohort) GROUP BY 1"""
    ),
)
def k1_grace_contiguous(spark, sf_dir):
    return (
        cohort(spark, sf_dir).groupBy(grace_column(True).alias("grace")).agg(F.count("*").alias("n"))
    )


@query(
    "k1_grace_band_rates",
    with_cohort(
        f"""SELECT {GRACE_BAND_SQL} AS band, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(mortality) AS BIGINT) AS events, {r6('avg(mortality)', 'event_rate')}
        FROM (SELECT mortality, {grace_sql()} AS grace FROM cohort) GROUP BY 1"""
    ),
)
def k1_grace_band_rates(spark, sf_dir):
    scored = cohort(spark, sf_dir).select("mortality", grace_column().alias("grace"))
    return rounded(
        scored.groupBy(scores.grace_band(F.col("grace")).alias("band")).agg(
            F.count("*").alias("n"),
            F.sum("mortality").alias("events"),
            F.avg("mortality").alias("event_rate"),
        )
    )


@query(
    "k2_timi",
    with_cohort(
        """SELECT patient_id, CAST(timi AS INT) AS timi,
        CASE WHEN timi <= 2 THEN 'low' WHEN timi <= 4 THEN 'intermediate' ELSE 'high' END AS band
        FROM (SELECT patient_id, (edad >= 65)::INT + (edad >= 75)::INT
          + coalesce((diabetes_mellitus = 1)::INT, 0) + (hipertension_arterial = 1)::INT
          + (infarto_miocardio_agudo = 1)::INT AS timi FROM cohort)"""
    ),
)
def k2_timi(spark, sf_dir):
    score = scores.timi_simple(
        "edad", F.col("diabetes_mellitus") == 1, F.col("hipertension_arterial") == 1,
        F.col("infarto_miocardio_agudo") == 1,
    )
    scored = cohort(spark, sf_dir).select("patient_id", score.alias("timi"))
    return scored.withColumn("band", scores.timi_simple_band(F.col("timi")))


def timi_nstemi_column():
    flag = lambda c: F.col(c) == 1
    return scores.timi_nstemi_partial(
        "edad",
        [
            flag("diabetes_mellitus"), flag("hipertension_arterial"), flag("tabaquismo"),
            flag("hiperlipoproteinemia"),
        ],
        flag("enfermedad_arterias_coronarias") | flag("infarto_miocardio_agudo"),
        flag("angina24h"),
        flag("depresion_st") | flag("infradesnivel"),
    )


TIMI_NSTEMI_SQL = """((edad >= 65)::INT
  + (coalesce(diabetes_mellitus, 0) + hipertension_arterial + tabaquismo + hiperlipoproteinemia >= 3)::INT
  + (enfermedad_arterias_coronarias = 1 OR infarto_miocardio_agudo = 1)::INT + angina24h
  + (depresion_st = 1 OR coalesce(infradesnivel, 0) = 1)::INT + 1)"""


@query(
    "k3_timi_nstemi",
    with_cohort(f"SELECT patient_id, CAST({TIMI_NSTEMI_SQL} AS INT) AS timi_nstemi FROM cohort"),
)
def k3_timi_nstemi(spark, sf_dir):
    return cohort(spark, sf_dir).select("patient_id", timi_nstemi_column().alias("timi_nstemi"))


def timi_stemi_column():
    return scores.timi_stemi(
        "edad", F.coalesce(F.col("diabetes_mellitus"), F.lit(0)) == 1,
        F.col("hipertension_arterial") == 1, "presion_arterial_sistolica", "frecuencia_cardiaca",
        F.col("indice_killip"), scores.decimal_comma("peso"),
        scores.any_positive(["v1", "v2", "v3", "v4"]), F.col("tiempo_isquemia").try_cast("double"),
    )


TIMI_STEMI_SQL = """(CASE WHEN edad >= 75 THEN 3 WHEN edad >= 65 THEN 2 ELSE 0 END
  + (coalesce(diabetes_mellitus, 0) = 1 OR hipertension_arterial = 1)::INT
  + CASE WHEN presion_arterial_sistolica < 100 THEN 3 ELSE 0 END
  + CASE WHEN frecuencia_cardiaca > 100 THEN 2 ELSE 0 END
  + CASE WHEN indice_killip <> 'I' THEN 2 ELSE 0 END
  + coalesce((try_cast(replace(peso, ',', '.') AS DOUBLE) < 67)::INT, 0)
  + (coalesce(v1, 0) + coalesce(v2, 0) + coalesce(v3, 0) + coalesce(v4, 0) > 0)::INT
  + coalesce((try_cast(tiempo_isquemia AS DOUBLE) > 240)::INT, 0))"""


@query(
    "k4_timi_stemi",
    with_cohort(f"SELECT patient_id, CAST({TIMI_STEMI_SQL} AS INT) AS timi_stemi FROM cohort"),
)
def k4_timi_stemi(spark, sf_dir):
    return cohort(spark, sf_dir).select("patient_id", timi_stemi_column().alias("timi_stemi"))


_BASE_POINTS = """(edad > 70)::INT + (presion_arterial_sistolica < 100)::INT
  + coalesce((filtrado_glomerular < 60)::INT, 0) * 3 + (indice_killip = 'IV')::INT"""
_NOT_NULL = " + ".join(f"({c} IS NOT NULL)::INT" for c in fv.ECG_LEADS)
_NOT_ZERO = " + ".join(f"(coalesce({c}, 0) <> 0)::INT" for c in fv.ECG_LEADS)
_PROBABILITY_SQL = (
    "CASE least(greatest(score, 0), 10) "
    + " ".join(f"WHEN {k} THEN {v}" for k, v in fv.REGISTRY_PROBABILITY.items())
    + " END"
)
_TOKENS = (
    "list_transform(regexp_split_to_array(lower(coalesce(complicaciones, '')), '[;,/|]+'), lambda t: trim(t))"
)


def _any(family) -> str:
    return f"list_has_any({_TOKENS}, [{', '.join(repr(t) for t in family)}])"


TOKEN_SCORE_SQL = f"""({_BASE_POINTS} + ({_NOT_NULL} > 7)::INT
  + 2 * {_any(fv.TOKENS_VF + fv.TOKENS_VT)}::INT + {_any(fv.TOKENS_AVB_HIGH)}::INT)"""
PART_SCORE_SQL = f"""({_BASE_POINTS} + ({_NOT_ZERO} > 7)::INT
  + 2 * regexp_matches(upper(coalesce(complicaciones, '')), 'FV|TV')::INT
  + regexp_matches(upper(coalesce(complicaciones, '')), 'BAV3|BAV2:1')::INT)"""


@query(
    "k5_registry_score",
    with_cohort(
        f"""SELECT patient_id, CAST(score AS INT) AS score,
        CASE WHEN score >= 4 THEN 'high' ELSE 'low' END AS band, {r6(_PROBABILITY_SQL, 'probability')}
        FROM (SELECT patient_id, {_BASE_POINTS} + ({_NOT_ZERO} > 7)::INT
           + 2 * (coalesce(complicaciones, '') = 'fv')::INT
           + (coalesce(complicaciones, '') = 'TV;bav3')::INT AS score FROM cohort)"""
    ),
)
def k5_registry_score(spark, sf_dir):
    parts = scores.registry_components(
        "edad", "presion_arterial_sistolica", "filtrado_glomerular", scores.leads_not_zero(),
        scores.killip_number("indice_killip") == 4, F.col("complicaciones") == "fv",
        F.col("complicaciones") == "TV;bav3",
    )
    scored = cohort(spark, sf_dir).select(
        "patient_id", scores.total(list(parts.values())).alias("score")
    )
    return rounded(
        scored.withColumns(
            {
                "band": scores.registry_band(F.col("score")),
                "probability": scores.registry_probability(F.col("score")),
            }
        )
    )


@query(
    "k6_registry_tokens",
    with_cohort(
        f"""SELECT patient_id, CAST(score AS INT) AS score,
        CASE WHEN score >= 4 THEN 'high' ELSE 'low' END AS band
        FROM (SELECT patient_id, {TOKEN_SCORE_SQL} AS score FROM cohort)"""
    ),
)
def k6_registry_tokens(spark, sf_dir):
    parts = scores.registry_from_tokens()
    scored = cohort(spark, sf_dir).select(
        "patient_id", scores.total(list(parts.values())).alias("score")
    )
    return scored.withColumn("band", scores.registry_band(F.col("score")))


@query(
    "k7_registry_patterns",
    with_cohort(
        f"""SELECT patient_id, age_gt_70, sbp_lt_100, gfr_lt_60, ecg_leads_gt_7, killip_iv, vf_vt,
          high_grade_avb, CAST(score AS INT) AS score, {r6(_PROBABILITY_SQL, 'probability')}
        FROM (SELECT *, age_gt_70 + sbp_lt_100 + gfr_lt_60 + ecg_leads_gt_7 + killip_iv + vf_vt
            + high_grade_avb AS score FROM (
          SELECT patient_id, (edad > 70)::INT AS age_gt_70,
          (presion_arterial_sistolica < 100)::INT AS sbp_lt_100,
          coalesce((filtrado_glomerular < 60)::INT, 0) * 3 AS gfr_lt_60,
          ({_NOT_ZERO} > 7)::INT AS ecg_leads_gt_7, (indice_killip = 'IV')::INT AS killip_iv,
          2 * regexp_matches(upper(coalesce(complicaciones, '')), '\\bFV\\b|\\bTV\\b')::INT AS vf_vt,
          regexp_matches(upper(coalesce(complicaciones, '')), 'BAV\\s*3|BAV\\s*2\\s*:\\s*1|BAV-?3')::INT
            AS high_grade_avb FROM cohort))"""
    ),
)
def k7_registry_patterns(spark, sf_dir):
    parts = scores.registry_from_patterns()
    scored = cohort(spark, sf_dir).select("patient_id", *[c.alias(n) for n, c in parts.items()])
    score = scores.total([F.col(n) for n in parts])
    return rounded(
        scored.withColumns(
            {"score": score, "probability": scores.registry_probability(score)}
        )
    )


@query(
    "k8_registry_report",
    with_cohort(
        f"""SELECT patient_id, CAST(score AS INT) AS score,
        CASE WHEN score >= 3 THEN 'high' ELSE 'low' END AS band
        FROM (SELECT patient_id, {PART_SCORE_SQL} AS score FROM cohort)"""
    ),
)
def k8_registry_report(spark, sf_dir):
    parts = scores.registry_from_parts()
    scored = cohort(spark, sf_dir).select(
        "patient_id", scores.total(list(parts.values())).alias("score")
    )
    return scored.withColumn("band", scores.registry_band(F.col("score"), high_from=3))


_FAMILIES = {
    "comp_fv": fv.TOKENS_VF,
    "comp_tv": fv.TOKENS_VT,
    "comp_fv_tv": fv.TOKENS_VF + fv.TOKENS_VT,
    "comp_bav_alto_grado": fv.TOKENS_AVB_HIGH,
    "comp_bav_bajo_grado": fv.TOKENS_AVB_LOW,
    "comp_shock": fv.TOKENS_SHOCK,
    "comp_ic": fv.TOKENS_HEART_FAILURE,
    "comp_pcr": fv.TOKENS_ARREST,
    "comp_otras_arritmias": fv.TOKENS_OTHER_ARRHYTHMIA,
    "comp_mecanicas": fv.TOKENS_MECHANICAL,
}


@query(
    "k9_complication_flags",
    with_cohort(
        "SELECT patient_id, "
        + ", ".join(f"{_any(f)}::INT AS {n}" for n, f in _FAMILIES.items())
        + " FROM cohort"
    ),
)
def k9_complication_flags(spark, sf_dir):
    flags = scores.complication_flags()
    return cohort(spark, sf_dir).select("patient_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "k9_complication_rates",
    with_cohort(
        " UNION ALL ".join(
            f"SELECT '{n}' AS variable, CAST(sum({_any(f)}::INT) AS BIGINT) AS n, "
            f"{r6(f'100.0 * avg({_any(f)}::INT)', 'pct')} FROM cohort"
            for n, f in _FAMILIES.items()
        )
    ),
)
def k9_complication_rates(spark, sf_dir):
    flags = scores.complication_flags()
    flagged = cohort(spark, sf_dir).select(*[c.alias(n) for n, c in flags.items()])
    row = flagged.agg(
        *[
            F.struct(F.sum(n).alias("n"), (100.0 * F.avg(n)).alias("pct")).alias(n)
            for n in flags
        ]
    )
    return rounded(row.unpivot([], list(flags), "variable", "s").select("variable", "s.n", "s.pct"))


@query(
    "k10_pseudo_probability",
    with_cohort(
        f"""SELECT patient_id, {r6('least(greatest(escala_grace / 200.0, 0), 1)', 'p')}
        FROM cohort WHERE escala_grace IS NOT NULL"""
    ),
)
def k10_pseudo_probability(spark, sf_dir):
    rows = cohort(spark, sf_dir).filter(F.col("escala_grace").isNotNull())
    return rounded(rows.select("patient_id", scores.pseudo_probability("escala_grace", 200).alias("p")))


@query(
    "p8_bands",
    with_cohort(
        """SELECT patient_id,
        CASE WHEN edad > 0 AND edad <= 50 THEN '(0,50]' WHEN edad <= 60 THEN '(50,60]'
          WHEN edad <= 70 THEN '(60,70]' WHEN edad <= 80 THEN '(70,80]' ELSE '(80,120]' END AS band,
        CASE WHEN edad < 65 THEN '18-64' WHEN edad < 75 THEN '65-74' ELSE '>=75' END AS age_group,
        CASE WHEN p_model < 0.1 THEN 'Low' WHEN p_model < 0.3 THEN 'Moderate' ELSE 'High' END AS stratum
        FROM cohort"""
    ),
)
def p8_bands(spark, sf_dir):
    return cohort(spark, sf_dir).select(
        "patient_id", bands.age_band("edad").alias("band"),
        bands.age_group("edad").alias("age_group"), bands.risk_stratum("p_model").alias("stratum"),
    )


@query(
    "p9_derived_columns",
    with_cohort(
        f"""SELECT patient_id, {r6("try_cast(replace(peso, ',', '.') AS DOUBLE) / 1.7 / 1.7", 'bmi')},
        {r6('(presion_arterial_sistolica + 2 * frecuencia_cardiaca) / 3', 'map')},
        {r6('presion_arterial_sistolica - frecuencia_cardiaca', 'pulse_pressure')},
        {r6('frecuencia_cardiaca / presion_arterial_sistolica', 'shock_index')},
        CAST(CASE WHEN sexo = 'masculino' THEN edad / 5 < 13 ELSE edad / 5 < 12 END AS INT) AS anaemia,
        CASE WHEN filtrado_glomerular IS NULL THEN NULL WHEN filtrado_glomerular < 15 THEN 'G5'
          WHEN filtrado_glomerular < 30 THEN 'G4' WHEN filtrado_glomerular < 45 THEN 'G3b'
          WHEN filtrado_glomerular < 60 THEN 'G3a' WHEN filtrado_glomerular < 90 THEN 'G2'
          ELSE 'G1' END AS kidney_stage
        FROM cohort"""
    ),
)
def p9_derived_columns(spark, sf_dir):
    weight = scores.decimal_comma("peso")
    return rounded(
        cohort(spark, sf_dir).select(
            "patient_id",
            bands.body_mass_index(weight, F.lit(170.0)).alias("bmi"),
            bands.mean_arterial_pressure("presion_arterial_sistolica", "frecuencia_cardiaca").alias("map"),
            bands.pulse_pressure("presion_arterial_sistolica", "frecuencia_cardiaca").alias("pulse_pressure"),
            bands.shock_index("frecuencia_cardiaca", "presion_arterial_sistolica").alias("shock_index"),
            bands.anaemia(F.col("edad") / 5, "sexo").alias("anaemia"),
            bands.kidney_stage("filtrado_glomerular").alias("kidney_stage"),
        )
    )
