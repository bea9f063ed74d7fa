"""The pipeline's stages take effect, keep clean documents and take odd tables."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_corpus_operators import SCHEMA, odd_rows, print_of

from riskloom.llm import contain


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    known = stage["language_id"](spark, docs.unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123 456", "en", "s", 0)], SCHEMA)), sf_dir).toPandas()
    assert set(known["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    single = stage["simhash_near_dedup"](spark, docs, sf_dir)
    rows = {r["doc_id"]: print_of(r["text"]) for r in docs.collect()}
    ids = sorted(rows)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and (rows[i] ^ rows[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(root.values()))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = {r["doc_id"] for r in contain.containment(docs, bench).collect()}
    clean = {r["doc_id"] for r in stage["benchmark_decontamination"](spark, docs, sf_dir).collect()}
    assert bad and clean == set(ids) - bad
    mixed = stage["source_mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_run_and_odd_tables(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("d")).filter("d <> 0").count() == 0
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).select(*docs.columns).collect(), SCHEMA)


def test_documents_without_labels_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, docs, sf_dir).count() == docs.count()
