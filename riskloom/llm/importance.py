"""Importance resampling towards a target distribution over hashed n-grams, with Gumbel noise for the draw.

Words come from a 256-byte table applied to the UTF-8 bytes (``bytes.translate``: A-Z to lower case, separators to a
blank) and ``bytes.split``. An n-gram's hash is crc32 of its words joined by one blank, grown from the (n-1)-gram's by
passing that as the seed. Each task reduces its features with a Counter to at most one row per bucket, so the corpus
counts are a sum of small tables. A second reading weighs each document by the mean gain of its features.

Nothing but the bucket tables (as long as ``buckets``) and one row per distinct score or range reaches the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import unused
from riskloom.session import cut_lineage

#: 0-9, a-z and bytes from 0x80 stay, A-Z become a-z, all others separate words.
BYTE_TABLE = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
OUTPUTS = ("n_words", "n_features", "weight", "score", "rank")
_MOST_COUNTED = 1 << 20  # distinct hashes a task's Counter holds before they are folded into buckets
_WEIGHT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(BYTE_TABLE).split() if text else []


def feature_hashes(found: list[bytes], ngrams: int = 1) -> list[int]:
    """crc32 of every run of 1 .. ``ngrams`` consecutive words."""
    grams = list(map(crc32, found))
    out = list(grams)
    for size in range(2, ngrams + 1):
        grams = list(map(crc32, found[size - 1 :], map(crc32, repeat(b" "), grams)))
        out += grams
    return out


def bucket_counts(texts: DataFrame, text: str = "text", ngrams: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features per bucket over the whole table; a task sends at most one row per bucket."""

    def folded(hashes: Counter[int]) -> Counter[int]:
        out: Counter[int] = Counter()
        for h, n in hashes.items():
            out[h % buckets] += n
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        hashes: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                hashes.update(feature_hashes(words(value), ngrams))
                if len(hashes) > _MOST_COUNTED:
                    total, hashes = total + folded(hashes), Counter()
        total = total + folded(hashes)
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())}
        )

    parts = texts.select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's share in the target to its share in the source)."""
    size = len(source)
    source_all, target_all = float(source.sum() + size), float(target.sum() + size)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * source_all / ((s + 1.0) * target_all))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def weigher(table: np.ndarray, ngrams: int):
    """Pandas UDF over UTF-8 bytes: words, features and the floored mean gain of the features (none: 0)."""
    buckets = len(table)

    @F.pandas_udf(_WEIGHT)
    def of(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 3), np.int64)
        for i, text in enumerate(texts):
            found = words(text)
            if found:
                hashes = feature_hashes(found, ngrams)
                total = int(table[np.array(hashes, np.int64) % buckets].sum())
                out[i] = len(found), len(hashes), total // len(hashes)
        return pd.DataFrame(out, columns=_WEIGHT.names)

    return of


def noise(key: Column, seed: int) -> Column:
    """Floored 1000-fold Gumbel noise from the first 32 bits of sha256(``seed:key``); a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("bigint")


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", ngrams: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score``; no shuffle of documents.

    A null, empty or blank text has no features and weight 0. Texts are read whole, however long. Repeated rows count
    each time. An empty target gives gains from the source alone; an empty ``docs`` gives no rows. Input columns named
    like an output are replaced (``text`` and ``key`` are read first), other columns stay.
    """
    source = bucket_counts(docs, text, ngrams, buckets)
    table = gains(source, bucket_counts(target, text, ngrams, buckets))
    (found,) = unused([*docs.columns, *OUTPUTS], "found")
    marked = docs.withColumn(found, weigher(table, ngrams)(F.col(text).cast("binary")))
    kept = [F.col(c) for c in docs.columns if c not in OUTPUTS]
    facts = [F.col(f"{found}.{n}").alias(n) for n in _WEIGHT.names]
    return marked.select(*kept, *facts, (F.col(f"{found}.weight") + noise(F.col(key), seed)).alias("score"))


def _numbered(scored: DataFrame) -> tuple[DataFrame, str]:
    """Written once with a row number, which makes the order of the draw total: equal rows differ in it alone."""
    (at,) = unused([*scored.columns, "rank"], "at")
    return cut_lineage(scored.withColumn(at, F.monotonically_increasing_id())), at


def _drawn(rows: DataFrame, key: str, at: str, percent: int, least_words: int) -> tuple[DataFrame, int | None, int]:
    """(rows that may be drawn with their ``rank``, the least score among them, how many are drawn).

    A histogram of the integer scores (as long as their spread, whatever the number of rows) gives the least score;
    the rows from it upward are cut into ranges of the total order, whose counts give each range's first rank.
    """
    able = rows.filter(F.col("n_words") >= least_words)
    counts = sorted(able.groupBy("score").count().collect(), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    least, held = None, 0
    for value, n in counts:
        if held >= wanted:
            break
        least, held = value, held + n
    if least is None:
        return able.limit(0).withColumn("rank", F.lit(None).cast("bigint")), None, 0
    spark = rows.sparkSession
    parts, order = unused(rows.columns, "part")[0], [F.desc("score"), F.asc_nulls_last(key), F.asc(at)]
    near = able.filter(F.col("score") >= least)
    ranges = near.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranges = cut_lineage(ranges.withColumn(parts, F.spark_partition_id()))
    before, first = 0, []
    for part, n in sorted(ranges.groupBy(parts).count().collect()):  # one row per range
        first.append((part, before))
        before += n
    start = unused([*rows.columns, parts], "start")[0]
    firsts = F.broadcast(spark.createDataFrame(first, f"{parts} int, {start} long"))
    place = F.row_number().over(Window.partitionBy(parts).orderBy(*order)) + F.col(start)
    ranked = ranges.join(firsts, parts).withColumn("rank", place.cast("bigint")).drop(parts, start)
    return ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))), least, wanted


def rank(scored: DataFrame, key: str = "doc_id", percent: int = 10, least_words: int = 20) -> DataFrame:
    """Every row of ``weigh`` with ``rank``: 1 .. floor(percent / 100 * N) for the highest scores, else null.

    N counts the rows with at least ``least_words`` words. Ties go to the smaller key, nulls last; rows alike in score
    and key take successive ranks in the order of their reading. Texts should be left out of ``scored``: rows move.
    """
    rows, at = _numbered(scored.drop("rank"))
    ranked, least, _ = _drawn(rows, key, at, percent, least_words)
    if least is None:
        return rows.drop(at).withColumn("rank", F.lit(None).cast("bigint"))
    able = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    return ranked.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))).drop(at)


def draw(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 10, least_words: int = 20, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, ``weight`` and ``score``.

    The documents are written once with their scores; the last drawn place of the total order then is a filter, so
    texts never cross a shuffle.
    """
    rows, at = _numbered(weigh(docs, target, text, key, **settings))
    slim = rows.select(F.col(key), "n_words", "score", F.col(at))
    ranked, least, wanted = _drawn(slim, key, at, percent, least_words)
    last = ranked.filter(F.col("rank") == wanted).first() if wanted else None
    if least is None or last is None:
        return rows.limit(0).drop(at)
    k, same_key = F.col(key), F.col(key).eqNullSafe(F.lit(last[key]))
    earlier = F.lit(True) if last[key] is None else F.coalesce(k < F.lit(last[key]), F.lit(False))
    tied = (F.col("score") == last["score"]) & ((earlier & ~same_key) | (same_key & (F.col(at) <= last[at])))
    return rows.filter((F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | tied)).drop(at)


def importance_sql(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """The same rows for single words, from DuckDB; crc32 is worked out bit by bit, once per distinct word."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
    dw AS (SELECT r, unnest(ws) AS w FROM d),
    bw AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) AS w FROM benchmark),
    steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1
        THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) x(i))),
    vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    crc AS (SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i:
        ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295)
        % {buckets} AS b FROM vocabulary, steps),
    s AS (SELECT b, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY b),
    g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {buckets})
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {buckets}))))::BIGINT AS g FROM s FULL JOIN t USING (b)),
    m AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g USING (b) GROUP BY r),
    e AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296)))::BIGINT)::BIGINT AS score FROM d LEFT JOIN m USING (r)),
    k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM e WHERE n_features >= {least_words}
        QUALIFY row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) <= (SELECT {percent} * count(*) // 100 FROM e WHERE n_features >= {least_words}))
    SELECT doc_id, n_features, weight, score, rank FROM e LEFT JOIN k USING (r)"""
