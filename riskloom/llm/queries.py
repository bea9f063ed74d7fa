"""The dealt operators bound to the test tables, with DuckDB check texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chat, contain, importance, langid, lines, minhash, mixing, negatives, repeats, secrets, shards, simhash, topk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_histogram_sort_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (~langid.in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score"
    )


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_poisson_mixing", mixing.mix_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.rates(docs))


@query("op8_benchmark_containment", contain.contain_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contain.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


TOP_K_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query("op4_pivot_top_k", TOP_K_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), every=100, k=10)


@query("op9_line_site_spread", lines.lines_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.drop_widespread_lines(docs, site="source", least=10).select("doc_id", "source", "text", "n_lines", "n_removed")


@query("op10_chat_windows", chat.chat_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.windows(chat.with_probe(table(spark, sf_dir, "conversations"))))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs.select("doc_id", "text"), secrets.train(docs))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), "base_sha256", F.col("span_text").alias("spans"))


REPEATS_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
    p AS (SELECT doc_id, unnest(t) AS word, unnest(generate_series(1, len(t))) AS pos,
        unnest(list_transform(generate_series(1, len(t)), lambda i: CASE WHEN i + 34 <= len(t) THEN array_to_string(t[i:i + 34], ' ') END)) AS run FROM w),
    s AS (SELECT doc_id, word, pos, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS starts FROM p),
    r AS (SELECT doc_id, word, pos,
        coalesce(bool_or(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM s),
    k AS (SELECT doc_id, count_if(gone)::BIGINT AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
    SELECT w.doc_id, len(t)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


@query("op3_recompression_repeats", REPEATS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op11_importance_resampling", importance.importance_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance.weigh(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return importance.rank(scored.drop("text")).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_tree_hard_negatives", negatives.negatives_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", moved)))


NEAR_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS t FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) < 2 THEN t ELSE list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) END) AS s FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS total, count(*) AS shared FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * (total - shared)),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, coalesce(b, doc_id) >= doc_id AS kept
    FROM s LEFT JOIN c ON a = doc_id"""


@query("op13_sketch_near_dedup", NEAR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
