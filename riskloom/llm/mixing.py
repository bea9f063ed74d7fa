"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is budget x weight / size. Each document gets a Poisson number of copies with that
mean, found by inverting the distribution at a uniform number hashed from its id, so the mix needs no counter, no
order and no second pass, and comes out alike on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import guarded
from riskloom.session import cut_lineage

TERMS = 20  # a draw has a mean of at most 1; more than 20 events then have a chance below 1e-19
_SPACE = float(1 << 52)


def hashed(*parts: Column) -> Column:
    """52-bit number from md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint")


def rates(docs: DataFrame, exponent: float = 0.5, epochs: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """``source, rate``: mean copies per document. Sizes are UTF-8 bytes.

    Target weights are ``weights(source, weight)`` where given (sources that it lacks get 0), else the sources' byte
    shares to the power ``exponent``; the budget is ``epochs`` times all bytes. A null source is a source of its own;
    a source without bytes gets rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")).alias("bytes"))
    if weights is None:
        known = sizes.withColumn("weight", F.pow("bytes", F.lit(exponent)))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        known = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    whole = known.agg(F.sum("bytes").alias("_all"), F.sum("weight").alias("_sum"))  # one row
    return known.crossJoin(F.broadcast(whole)).select(
        "source",
        F.when((F.col("bytes") > 0) & (F.col("_sum") > 0), F.coalesce("weight", F.lit(0.0)) / F.col("_sum") * F.col("_all") * epochs / F.col("bytes"))
        .otherwise(0.0)
        .alias("rate"),
    )


@guarded("_source", "_parts", "_cdf", "_n")
def replicate(docs: DataFrame, repetition: DataFrame, seed: int = 11) -> DataFrame:
    """Every row repeated by its Poisson count, with ``replica`` (from 0) and ``shuffle_key``, in a global shuffle.

    ``repetition``: ``source, rate``. A rate above 1 is drawn as the sum of ceil(rate) equal parts, each from its own
    hash. Rows alike in doc_id get the same count. Rows move once, by shuffle_key, and lie in its order inside each
    partition. All input columns stay; columns named like the two new ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("replica", "shuffle_key")]
    parts = F.greatest(F.ceil("rate"), F.lit(1)).cast("int")
    # Written first: the planner then knows its size and joins a small one without moving texts by source.
    tables = cut_lineage(
        repetition.withColumn("_parts", parts)
        .withColumn("_mean", F.col("rate") / F.col("_parts"))
        .withColumn("_terms", F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.exp(-F.col("_mean")) * F.pow(F.col("_mean"), k) / F.factorial(k)))
        .select(
            F.col("source").alias("_source"),
            "_parts",
            F.transform(F.sequence(F.lit(1), F.lit(TERMS + 1)), lambda k: F.aggregate(F.slice("_terms", 1, k), F.lit(0.0), lambda a, b: a + b)).alias("_cdf"),
        )
    )
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0),
        lambda total, part: total + F.size(F.filter("_cdf", lambda c: c <= hashed(F.lit(str(seed)), part.cast("string"), doc) / _SPACE)),
    )
    copies = docs.join(tables, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_n", drawn).filter("_n > 0")
    repeated = copies.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    keyed = repeated.select(*names, "replica", hashed(F.lit(f"{seed}:order"), F.col("replica").cast("string"), doc).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "replica")


def mix_sql(exponent: float = 0.5, seed: int = 11) -> str:
    """DuckDB text for ``replicate(docs, rates(docs, exponent))`` over ``documents``, without the order."""
    return f"""
    WITH sized AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0))::DOUBLE AS bytes FROM documents GROUP BY source),
    known AS (SELECT source, bytes, pow(bytes, {exponent}) AS weight FROM sized),
    rated AS (SELECT source, CASE WHEN bytes > 0 THEN weight / sum(weight) OVER () * sum(bytes) OVER () / bytes ELSE 0 END AS rate FROM known),
    parted AS (SELECT source, rate, greatest(ceil(rate), 1)::INT AS parts FROM rated),
    cdf AS (
      SELECT source, parts, list(c) AS cdf FROM (
        SELECT source, parts, k, sum(exp(-rate / parts) * pow(rate / parts, k) / factorial(k::INT)) OVER (PARTITION BY source ORDER BY k) AS c
        FROM parted, range(0, {TERMS + 1}) r(k)) GROUP BY source, parts),
    drawn AS (
      SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda p: len(list_filter(cdf,
        lambda c: c <= ('0x' || md5('{seed}:' || p || ':' || coalesce(d.doc_id::VARCHAR, ''))[1:13])::BIGINT / {_SPACE}))))::INT AS n
      FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
    SELECT doc_id, text, lang, source, n_chars, replica::INT AS replica,
      ('0x' || md5('{seed}:order:' || replica || ':' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT AS shuffle_key
    FROM drawn, unnest(range(0, n)) u(replica)"""
