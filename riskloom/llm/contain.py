"""Benchmark decontamination: size-partitioned bottom-k MinHash containment search, then exact shingle containment.

An item with n distinct shingles keeps its k smallest shingle hashes as signature, k = n - ceil(t n) + 1. A document
that holds at least a share t of the item misses at most k - 1 of its shingles, so it holds at least one signature
hash: the search loses nothing. Items are partitioned by size (powers of two); each partition has a hash bound, the
largest hash of its signatures, and a least document size, so a document probes only with its small hashes and only
for the partitions that it is large enough to contain. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import guarded, let
from riskloom.session import cut_lineage


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _starts(words: Column, length: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - length, F.lit(0)))


def shingle_hashes(text: Column, length: int) -> Column:
    """One hash per shingle; a text with fewer words has one shingle, a text without words none."""
    return let(
        normal_words(text),
        lambda w: F.when(
            F.size(w) > 0, F.transform(_starts(w, length), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(length)]))
        ).otherwise(F.array().cast("array<bigint>")),
    )


def shingle_texts(text: Column, length: int) -> Column:
    """The distinct shingles themselves."""
    return let(
        normal_words(text),
        lambda w: F.when(
            F.size(w) > 0, F.array_distinct(F.transform(_starts(w, length), lambda i: F.array_join(F.slice(w, i + 1, length), " ")))
        ).otherwise(F.array().cast("array<string>")),
    )


def _needed(n: Column, share: float) -> Column:
    return F.ceil(n * share - 1e-9).cast("int")


def _row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), key.isNull(), text, text.isNull())


def containment(docs: DataFrame, items: DataFrame, length: int = 5, share: float = 0.8) -> DataFrame:
    """``_row, doc_id, item_id, n_item, n_shared, containment`` for every row of ``docs`` and item it contains.

    Containment is the share of the item's distinct shingles that occur in the document. Items or documents without
    words (null included) match nothing; a text shorter than a shingle is one shingle. Repeated items count once,
    repeated documents each give their own row. ``_row`` is a hash of doc_id and text.
    """
    found = docs.select(F.col("doc_id"), F.col("text"), _row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    known = cut_lineage(
        items.select("item_id", "text")
        .distinct()
        .select("item_id", _row_key(F.col("item_id"), F.col("text")).alias("item"), shingle_texts(F.col("text"), length).alias("texts"),
                F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), length))).alias("hashes"))
        .filter(F.size("hashes") > 0)
        .withColumn("need", _needed(F.size("hashes"), share))
        .withColumn("band", F.floor(F.log2(F.size("hashes"))).cast("int"))
        .withColumn("signature", F.expr("slice(hashes, 1, size(hashes) - need + 1)"))
    )
    bands = known.groupBy("band").agg(F.min("need").alias("need"), F.max(F.array_max("signature")).alias("bound")).collect()
    marks = cut_lineage(known.select("item", F.explode("signature").alias("hash")).distinct())

    def probes(hashes: Column) -> Column:
        bound = F.lit(None).cast("bigint")
        for b in bands:  # one per power of two
            bound = F.greatest(bound, F.when(F.size(hashes) >= b["need"], F.lit(b["bound"])))
        return let(bound, lambda most: F.filter(hashes, lambda h: h <= most))

    sketch = found.select("_row", F.explode(let(shingle_hashes(F.col("text"), length), probes)).alias("hash"))
    candidates = cut_lineage(sketch.join(marks, "hash").select("_row", "item").distinct())
    per_row = cut_lineage(candidates.groupBy("_row").agg(F.collect_set("item").alias("candidates")))
    held = found.join(per_row, "_row").select("_row", "doc_id", shingle_texts(F.col("text"), length).alias("own"), "candidates")
    pairs = held.select("_row", "doc_id", "own", F.explode("candidates").alias("item")).join(known.select("item", "item_id", "texts"), "item")
    counted = pairs.select(
        "_row", "doc_id", "item_id", F.size("texts").alias("n_item"), F.size(F.array_intersect("own", "texts")).alias("n_shared")
    )
    return counted.filter(F.col("n_shared") >= _needed(F.col("n_item"), share)).withColumn(
        "containment", F.col("n_shared") / F.col("n_item")
    )


@guarded("_row")
def decontaminate(docs: DataFrame, items: DataFrame, length: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns stay."""
    bad = cut_lineage(containment(docs, items, length, share).select("_row").distinct())
    names = docs.columns
    return docs.withColumn("_row", _row_key(F.col("doc_id"), F.col("text"))).join(bad, "_row", "left_anti").select(*names)


def contain_sql(length: int = 5, share: float = 0.8) -> str:
    """DuckDB text for the (doc_id, item_id) rows of ``containment`` over documents and benchmark."""

    def shingles(name: str, key: str) -> str:
        return f"""
        {name}_words AS (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {{0}}),
        {name} AS (SELECT DISTINCT {key}, unnest(list_transform(range(0, greatest(len(w) - {length}, 0) + 1), lambda i: array_to_string(w[i + 1:i + {length}], ' '))) AS s
          FROM {name}_words WHERE len(w) > 0)"""

    docs = shingles("d", "doc_id").replace("{0}", "documents")
    items = shingles("b", "item_id").replace("{0}", "benchmark")
    return f"""WITH {docs}, {items},
    sized AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
    met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n_item::INT AS n_item, n_shared::INT AS n_shared, n_shared / n_item AS containment
    FROM met JOIN sized USING (item_id) WHERE n_shared >= ceil(n_item * {share} - 1e-9)"""
