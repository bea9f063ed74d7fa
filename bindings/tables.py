"""Sources, projections and column selection."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from bindings.base import cohort, query, r6, rounded, table, with_cohort
from riskloom.operators import project
from riskloom.session import shared_folder
from riskloom.sources import tables


def scratch(spark) -> str:
    """New folder for one round trip through a file format."""
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


@query(
    "s1_read_table",
    f"""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, {r6('sum(l_quantity)', 'quantity')}
    FROM lineitem GROUP BY 1""",
)
def s1_read_table(spark, sf_dir):
    rows = tables.read_table(spark, f"{sf_dir}/lineitem.parquet")
    return rounded(
        rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    )


@query(
    "s2_csv_encoding_fallback",
    "SELECT doc_id, CAST(length(text) AS INT) AS n_letters, md5(text) AS digest FROM documents",
)
def s2_csv_encoding_fallback(spark, sf_dir):
    """Documents written as latin-1 csv and read back through the encoding probe."""
    path = f"{scratch(spark)}/documents.csv"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # cells hold line breaks and quotes; the letters are all in latin-1, so the utf-8 probe must fall back
    latin = docs.write.option("header", True).option("escape", '"').option("encoding", "iso-8859-1")
    latin.csv(path)
    back = tables.read_csv(spark, path, schema=docs.schema)
    return back.select("doc_id", F.length("text").alias("n_letters"), F.md5(F.encode("text", "utf-8")).alias("digest"))


@query(
    "s3_decimal_comma",
    with_cohort(
        f"""SELECT patient_id, {r6("try_cast(replace(peso, ',', '.') AS DOUBLE)", 'peso')} FROM cohort"""
    ),
)
def s3_decimal_comma(spark, sf_dir):
    path = f"{scratch(spark)}/weights.csv"
    cohort(spark, sf_dir).select("patient_id", "peso").write.option("header", True).option(
        "sep", ";"
    ).option("encoding", "iso-8859-1").csv(path)
    back = tables.read_decimal_comma_csv(spark, path, ["peso"])
    return rounded(back.select(F.col("patient_id").cast("long").alias("patient_id"), "peso"))


@query(
    "s4_write_table",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
)
def s4_write_table(spark, sf_dir):
    path = f"{scratch(spark)}/supplier.parquet"
    tables.write_table(table(spark, sf_dir, "supplier"), path)
    return tables.read_table(spark, path)


@query(
    "s5_snapshots",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(d) AS snapshot_day FROM (
      SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS d,
        max(CAST(CAST(ts AS DATE) AS VARCHAR)) OVER (PARTITION BY event_type) AS newest FROM events)
    WHERE d = newest GROUP BY 1""",
)
def s5_snapshots(spark, sf_dir):
    """Event days as versions of each event type; the newest version of each is kept."""
    days = table(spark, sf_dir, "events").select(
        "event_type", F.col("ts").cast("date").cast("string").alias("snapshot_day")
    )
    newest = tables.newest_version(days, "event_type", "snapshot_day")
    return newest.groupBy("event_type").agg(
        F.count("*").alias("n"), F.max("snapshot_day").alias("snapshot_day")
    )


@query(
    "s5_snapshot_round_trip",
    f"""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, {r6('sum(o_totalprice)', 'total')}
    FROM orders GROUP BY 1""",
)
def s5_snapshot_round_trip(spark, sf_dir):
    """Two versions of the orders and one of another table are written; the newest of the orders is read."""
    orders = table(spark, sf_dir, "orders")
    root = scratch(spark)
    tables.write_snapshot(orders.filter("o_orderstatus = 'F'"), root, "orders", datetime(2024, 1, 1))
    tables.write_snapshot(orders, root, "orders", datetime(2024, 1, 2))
    tables.write_snapshot(orders.filter("o_orderstatus = 'O'"), root, "other", datetime(2024, 1, 3))
    newest = tables.read_latest_snapshot(spark, root, "orders")
    return rounded(newest.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))


@query(
    "p1_features",
    with_cohort(
        f"""SELECT {r6('sum(edad)', 'edad')}, CAST(count(diabetes_mellitus) AS BIGINT) AS diabetes,
        CAST(0 AS INT) AS has_key, CAST(0 AS INT) AS has_target FROM cohort"""
    ),
)
def p1_features(spark, sf_dir):
    features = project.features_of(cohort(spark, sf_dir), "mortality")
    return rounded(
        features.agg(
            F.sum("edad").alias("edad"),
            F.count("diabetes_mellitus").alias("diabetes"),
            F.lit(int("patient_id" in features.columns)).alias("has_key"),
            F.lit(int("mortality" in features.columns)).alias("has_target"),
        )
    )


_TEXT = ["sexo", "indice_killip", "peso", "tiempo_isquemia", "complicaciones"]


@query(
    "p3_leakage_filter",
    with_cohort(
        " UNION ALL ".join(
            f"SELECT '{c}' AS variable FROM cohort HAVING avg((try_cast({c} AS DOUBLE) IS NOT NULL)::INT) > 0.5"
            for c in _TEXT
        )
        + " UNION ALL SELECT unnest(['edad', 'creatinina']) AS variable"
    ),
)
def p3_leakage_filter(spark, sf_dir):
    rows = cohort(spark, sf_dir).select("edad", "creatinina", "mortality", *_TEXT)
    kept = project.drop_leakage(rows, deny=["MORTALITY"])
    return spark.createDataFrame([(c,) for c in kept.columns], "variable string")


_INPUTS = ["edad", "frecuencia_cardiaca", "presion_arterial_sistolica", "creatinina"]


@query(
    "p5_score_inputs",
    with_cohort(f"SELECT patient_id, {', '.join(_INPUTS)}, indice_killip FROM cohort"),
)
def p5_score_inputs(spark, sf_dir):
    return project.score_inputs(cohort(spark, sf_dir), _INPUTS)


@query(
    "p7_analysis_set",
    with_cohort(
        f""", m AS (SELECT median(creatinina) AS c, median(filtrado_glomerular) AS f,
          median(try_cast(tiempo_isquemia AS DOUBLE)) AS t FROM cohort)
        SELECT patient_id, mortality, {r6('coalesce(creatinina, m.c)', 'creatinina')},
        {r6('coalesce(filtrado_glomerular, m.f)', 'filtrado_glomerular')},
        {r6('coalesce(try_cast(tiempo_isquemia AS DOUBLE), m.t)', 'tiempo_isquemia')} FROM cohort, m"""
    ),
)
def p7_analysis_set(spark, sf_dir):
    columns = ["creatinina", "filtrado_glomerular", "tiempo_isquemia"]
    return rounded(project.analysis_set(cohort(spark, sf_dir), columns, "mortality", "patient_id"))


@query(
    "k12_score_side_table",
    with_cohort(
        f"""SELECT patient_id, {', '.join(_INPUTS)}, indice_killip FROM cohort
        WHERE patient_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
    ),
)
def k12_score_side_table(spark, sf_dir):
    test_keys = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(F.col("o_orderkey").alias("patient_id"))
    )
    return project.score_inputs(cohort(spark, sf_dir), _INPUTS, test_keys)
