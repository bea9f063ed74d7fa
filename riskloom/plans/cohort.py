"""One wide row per case, derived from the orders table by integer arithmetic.

The same text runs in Spark and in DuckDB, so both sides of a check read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COHORT_SQL = """
SELECT
  o_orderkey AS patient_id,
  CAST(25 + (o_orderkey * 7919) % 73 AS DOUBLE) AS edad,
  CASE WHEN (o_orderkey * 31) % 3 = 0 THEN 'femenino' ELSE 'masculino' END AS sexo,
  CAST(40 + (o_orderkey * 613) % 171 AS DOUBLE) AS frecuencia_cardiaca,
  CAST(70 + (o_orderkey * 389) % 141 AS DOUBLE) AS presion_arterial_sistolica,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 271) % 450 AS DOUBLE) / 100 END AS creatinina,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(10 + (o_orderkey * 157) % 120 AS DOUBLE) END AS filtrado_glomerular,
  CASE WHEN (o_orderkey * 97) % 20 = 0 THEN 'IV' WHEN (o_orderkey * 97) % 20 <= 2 THEN 'III'
       WHEN (o_orderkey * 97) % 20 <= 6 THEN 'II' ELSE 'I' END AS indice_killip,
  CAST((o_orderkey * 53) % 2 AS INT) AS depresion_st,
  CAST(CASE WHEN (o_orderkey * 41) % 50 = 0 THEN 1 ELSE 0 END AS INT) AS paro_cardiaco,
  CAST(CASE WHEN (o_orderkey * 59) % 8 = 0 THEN 0 ELSE 1 END AS INT) AS scacest,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST((o_orderkey * 61) % 2 AS INT) END AS infradesnivel,
  CASE WHEN (o_orderkey * 67) % 10 < 3 THEN 1 WHEN o_orderkey % 23 = 0 THEN NULL ELSE 0 END AS diabetes_mellitus,
  CASE WHEN (o_orderkey * 71) % 10 < 7 THEN 1 ELSE 0 END AS hipertension_arterial,
  CASE WHEN (o_orderkey * 73) % 11 < 4 THEN 1 ELSE 0 END AS tabaquismo,
  CASE WHEN (o_orderkey * 79) % 5 = 0 THEN 1 ELSE 0 END AS hiperlipoproteinemia,
  CASE WHEN (o_orderkey * 83) % 9 = 0 THEN 1 ELSE 0 END AS enfermedad_arterias_coronarias,
  CASE WHEN (o_orderkey * 89) % 8 = 0 THEN 1 ELSE 0 END AS infarto_miocardio_agudo,
  CASE WHEN (o_orderkey * 101) % 6 = 0 THEN 1 ELSE 0 END AS angina24h,
  CASE WHEN o_orderkey % 29 = 0 THEN 's/d' ELSE concat(CAST(50 + (o_orderkey * 103) % 50 AS VARCHAR(9)), ',5') END AS peso,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST((o_orderkey * 107) % 720 AS VARCHAR(9)) END AS tiempo_isquemia,
  CASE WHEN o_orderkey % 17 = 0 THEN 'TV;bav3' WHEN o_orderkey % 17 = 1 THEN 'fv'
       WHEN o_orderkey % 17 = 2 THEN 'bav1' WHEN o_orderkey % 17 = 3 THEN 'pcr-fv, shock'
       WHEN o_orderkey % 17 = 4 THEN 'BAV2:1|ts' WHEN o_orderkey % 17 = 5 THEN 'ESTV'
       WHEN o_orderkey % 17 = 6 THEN ' ' ELSE NULL END AS complicaciones,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INT) END AS v1,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS v2,
  CASE WHEN (o_orderkey * 3) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 7) % 3 AS INT) END AS v3,
  CASE WHEN (o_orderkey * 5) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 9) % 3 AS INT) END AS v4,
  CASE WHEN (o_orderkey * 7) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 11) % 3 AS INT) END AS v5,
  CASE WHEN (o_orderkey * 11) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 15) % 3 AS INT) END AS v6,
  CASE WHEN (o_orderkey * 13) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 17) % 3 AS INT) END AS v7,
  CASE WHEN (o_orderkey * 17) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 21) % 3 AS INT) END AS v8,
  CASE WHEN (o_orderkey * 19) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 23) % 3 AS INT) END AS v9,
  CASE WHEN (o_orderkey * 23) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 27) % 3 AS INT) END AS d1,
  CASE WHEN (o_orderkey * 29) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 33) % 3 AS INT) END AS d2,
  CASE WHEN (o_orderkey * 31) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 35) % 3 AS INT) END AS d3,
  CASE WHEN (o_orderkey * 37) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 41) % 3 AS INT) END AS avl,
  CASE WHEN (o_orderkey * 41) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 45) % 3 AS INT) END AS avf,
  CASE WHEN (o_orderkey * 43) % 5 < 2 THEN NULL ELSE CAST((o_orderkey * 47) % 3 AS INT) END AS avr,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(60 + ((o_orderkey * 7919) % 73) * 2 + (o_orderkey * 109) % 40 AS DOUBLE) END AS escala_grace,
  o_orderdate AS fecha_ingreso,
  CAST(CASE WHEN (o_orderkey * 104729 + 17) % 1000
            < ((o_orderkey * 7919) % 73) * 2 + CASE WHEN (o_orderkey * 97) % 20 = 0 THEN 400 ELSE 0 END
       THEN 1 ELSE 0 END AS INT) AS mortality,
  CAST(((o_orderkey * 7919) % 73) * 8 + CASE WHEN (o_orderkey * 97) % 20 = 0 THEN 300 ELSE 0 END
       + (o_orderkey * 17) % 100 AS DOUBLE) / 1000 AS p_model,
  CAST(floor(((o_orderkey * 7919) % 73) / 8.0) AS DOUBLE) / 10 AS p_points
FROM orders
"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(COHORT_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
