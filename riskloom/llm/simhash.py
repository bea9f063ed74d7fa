"""SimHash near-duplicates by multi-index hashing: segment lookups with small Hamming balls, then full distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.components import components
from riskloom.llm.text import guarded
from riskloom.session import cut_lineage

_SPAN = 60_000  # shingles summed in 16-bit lanes at a time

#: For a byte value: its bits 0-3 and its bits 4-7, each as one count in a 16-bit lane of a 64-bit word.
_LANES = np.array(
    [[sum(((v >> (4 * half + i)) & 1) << (16 * i) for i in range(4)) for v in range(256)] for half in (0, 1)], np.uint64
)


def _hashes(text: str, shingle: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :])]


def _block_fingerprints(hashes: list[list[int]]) -> np.ndarray:
    owner, starts, at = [], [], 0
    for k, h in enumerate(hashes):
        for i in range(0, len(h), _SPAN):
            owner.append(k)
            starts.append(at + i)
        at += len(h)
    out = np.zeros(len(hashes), np.uint64)
    if not starts:
        return out
    parts = np.fromiter((x for h in hashes for x in h), np.uint64, at).view(np.uint8).reshape(-1, 8)
    owner, sizes = np.array(owner), np.array([len(h) for h in hashes])
    for byte in range(8):
        column = parts[:, byte]
        for half in (0, 1):
            sums = np.add.reduceat(_LANES[half][column], starts)
            for i in range(4):
                lane = ((sums >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)
                ones = np.bincount(owner, lane, len(hashes))
                out |= (2 * ones > sizes).astype(np.uint64) << np.uint64(8 * byte + 4 * half + i)
    return out


def fingerprint(shingle: int = 3):
    """Pandas UDF: 64-bit fingerprint of a whole text as a signed long; a text without words (or null) gives 0."""

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, block, size = [], [], 0
            for text in texts:
                block.append(_hashes(text, shingle) if text else [])
                size += len(block[-1])
                if size > 200_000:
                    out.append(_block_fingerprints(block))
                    block, size = [], 0
            out.append(_block_fingerprints(block))
            yield pd.Series(np.concatenate(out).view(np.int64))

    return of


def _zero_bits(fp: Column, first: int, last: int) -> Column:
    """Positions first .. last-1 at which the fingerprint has a 0."""
    return F.filter(F.sequence(F.lit(first), F.lit(last - 1)), lambda i: F.lit(1).cast("bigint").bitwiseAND(_shifted(fp, i)) == 0)


def _shifted(fp: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, by)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _mask(first: int, last: int) -> int:
    """Signed long with ones at bits first .. last-1."""
    value = ((1 << (last - first)) - 1) << first
    return value - (1 << 64) if value >= 1 << 63 else value


def _segments(distance: int) -> list[tuple[int, int]]:
    """First bit and end of every segment: of distance // 2 + 1 segments, one holds at most one error."""
    count = distance // 2 + 1
    cuts = [64 * k // count for k in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b, bits`` for all pairs of distinct values in ``prints(fp)`` that differ in at most ``distance`` bits.

    There is one table per segment: it holds every fingerprint under the segment's bits. A probe looks up the ball of
    radius 1 around its own segment: the segment itself and the segment with one 0 set (a partner with the 0 sees this
    one from the other side). Full distances decide. A pair is taken from the first table whose segment has at most
    one error, so it is met once.
    """
    fp = F.col("fp")
    segments = _segments(distance)

    def entry(table: int, key: Column, flipped: bool) -> Column:
        return F.struct(F.lit(table).alias("t"), key.alias("key"), F.lit(flipped).alias("flipped"))

    def masked(bits: Column, first: int, last: int) -> Column:
        return bits.bitwiseAND(F.lit(_mask(first, last)).cast("bigint"))

    stored = F.array(*[entry(t, masked(fp, *cut), False) for t, cut in enumerate(segments)])

    def ball(table: int, first: int, last: int) -> Column:
        return F.transform(_zero_bits(fp, first, last), lambda i: entry(table, masked(fp, first, last).bitwiseOR(_bit(i)), True))

    probed = F.concat(stored, *[ball(t, *cut) for t, cut in enumerate(segments)])
    left = prints.select(fp.alias("x"), F.explode(probed).alias("p")).select("x", "p.*")
    right = prints.select(fp.alias("y"), F.explode(stored).alias("p")).select("y", "p.t", "p.key")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    bits = F.bit_count(differ)
    once = F.when(F.col("flipped"), F.lit(True)).otherwise(F.col("x") < F.col("y"))
    for t, cut in enumerate(segments[:-1]):
        once = once & ((F.col("t") <= t) | (F.bit_count(masked(differ, *cut)) > 1))
    found = left.join(right, ["t", "key"]).filter((bits <= distance) & once)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), bits.alias("bits"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def _classes(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for every row; texts are read and fingerprinted once."""
    rows = cut_lineage(docs.select(
        "doc_id", _text_hash(F.col("text")).alias("text_hash"), fingerprint(shingle)(F.col("text")).alias("fp")
    ))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("fp"), distance))
    named = cut_lineage(
        prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, fp, root, component_id`` for every row: components over fingerprints at most ``distance`` bits apart.

    component_id is the smallest non-null doc_id of the component (null if it has none). Equal fingerprints are one
    node, so copies add no links; a null or empty text has fingerprint 0 and is linked like any other.
    """
    return _classes(docs, shingle, distance).select("doc_id", "fp", "root", "component_id")


@guarded("_id", "_hash", "_nth")
def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, one row each; all input columns stay.

    Of rows that share this doc_id, the smallest fingerprint and text hash decide; of rows alike in doc_id and text,
    the first by their other plain columns stays.
    """

    def key(doc_id: Column) -> Column:  # never null, and a null id meets no other
        return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))

    winners = (
        _classes(docs, shingle, distance)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min(F.struct("fp", "text_hash")).alias("w"), F.min("component_id").alias("id"))
        .select(key(F.col("id")).alias("_id"), F.col("w.text_hash").alias("_hash"))
    )
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    # Join and window share one partitioning, so whole texts move once.
    marked = docs.withColumns({"_id": key(F.col("doc_id")), "_hash": _text_hash(F.col("text"))})
    first = Window.partitionBy("_id", "_hash").orderBy(*plain)
    met = marked.join(winners, ["_id", "_hash"]).withColumn("_nth", F.row_number().over(first))
    return met.filter("_nth = 1").select(*docs.columns)
