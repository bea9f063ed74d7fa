"""MinHash near-duplicates by fast similarity sketching, banding and exact confirmation on whole shingle sets.

A sketch has a fixed number of bins. In round r every shingle is hashed into one bin with the value (r, hash); a bin keeps
its least value. From round ``bins`` on, round r fills bin r - ``bins`` with all shingles, so after at most 2 ``bins``
rounds every bin is filled; a set stops after the first round that leaves none empty. Each coordinate then agrees
between two sets with the probability of their Jaccard similarity, and the coordinates concentrate like those of
independent samples although a large set needs a few rounds only.

Documents of one shingle set are one class. Classes that agree in a band of coordinates share a bucket. Each member is
compared with the bucket's first class; members that are still in different components are compared with one another in
blocks, so that no candidate pair is left out and no group is expanded into all its pairs. A link counts only when the
two sets, rebuilt from the texts, are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.components import components
from riskloom.llm.text import unused
from riskloom.session import cut_lineage

_EMPTY = np.uint64((1 << 64) - 1)
_AT_ONCE = 200_000  # shingles sketched together
_KINDS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
])


def shingles(text: bytes | None, size: int) -> set[bytes]:
    """Distinct runs of ``size`` words, lower-cased in A-Z; of fewer words the whole sequence; none of no words."""
    found = text.lower().split() if text else []
    if len(found) < size:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(size)))))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Splitmix64 finaliser of 64-bit values, salted by the round."""
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(hashes: list[np.ndarray], bins: int) -> np.ndarray:
    """(sets, bins) coordinates of sets of 64-bit shingle hashes; an empty set has empty bins only."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.full((len(hashes), bins), _EMPTY)
    flat, owner = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.repeat(np.arange(len(hashes)), sizes)
    for turn in range(2 * bins):
        if not len(flat):
            break
        x = _mixed(flat, turn)
        at = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(out.reshape(-1), owner * bins + at, (x & np.uint64(0xFFFFFFFF)) | np.uint64(turn << 32))
        still = (out == _EMPTY).any(axis=1)[owner]
        flat, owner = flat[still], owner[still]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) one 64-bit key for every ``rows`` consecutive coordinates."""
    parts = sketch.reshape(len(sketch), -1, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        key = _mixed(key ^ parts[:, :, i], i)
    return key.view(np.int64)


def sketcher(size: int, bands: int, rows: int):
    """Pandas UDF over UTF-8 bytes: number of shingles, a 128-bit name of the set (null if empty), band keys."""
    digest = xxhash.xxh64_intdigest

    def block(sets: list[set[bytes]]) -> np.ndarray:
        return band_keys(sketches([np.fromiter(map(digest, s), np.uint64, len(s)) for s in sets], bands * rows), rows)

    @F.pandas_udf(_KINDS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            counts, names, keys = [], [], []
            waiting: list[set[bytes]] = []
            held = 0
            for text in texts:
                found = shingles(text, size)
                counts.append(len(found))
                names.append(blake2b(b"\n".join(sorted(found)), digest_size=16).digest() if found else None)
                waiting.append(found)
                held += len(found)
                if held > _AT_ONCE:
                    keys += list(block(waiting))
                    waiting, held = [], 0
            if waiting:
                keys += list(block(waiting))
            yield pd.DataFrame({"n": counts, "class": names, "bands": [k if c else [] for k, c in zip(keys, counts)]})

    return of


def similar(a: set[bytes], b: set[bytes], percent: int) -> bool:
    shared = len(a & b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmed(size: int, percent: int):
    """Pandas UDF over two texts' bytes: whether their shingle sets are similar; neighbouring equal texts are cut once."""

    @F.pandas_udf(T.BooleanType())
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, cut = None, set()
        for left, right in batches:
            out = []
            for a, b in zip(left, right):
                if b != last:
                    last, cut = b, shingles(b, size)
                out.append(similar(shingles(a, size), cut, percent))
            yield pd.Series(out, dtype=bool)

    return of


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _text_key(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def _rows(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, h, n, class, bands`` of every row, written once; texts are read whole."""
    text = F.col("text")
    marked = docs.select("doc_id", _text_key(text).alias("h"), sketcher(size, bands, rows)(text.cast("binary")).alias("k"))
    return cut_lineage(marked.select("doc_id", "h", "k.n", "k.class", "k.bands"))


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``band, key, pivot, n, pivot_n`` of buckets with company, ``class, n`` with ``band, key`` of their members).

    Buckets with the same members are one: two exclusive-or digests of the members tell them apart, without collecting.
    """
    entries = classes.select("class", "n", F.posexplode("bands").alias("band", "key"))
    found = entries.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("members"), F.min("class").alias("pivot"),
        F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"),
    )
    alone = found.filter("members > 1").groupBy("members", "x", "y").agg(F.min(F.struct("band", "key", "pivot")).alias("b"))
    buckets = cut_lineage(alone.select("b.*"))
    return buckets, cut_lineage(entries.join(buckets, ["band", "key"]))


def _texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``class, text`` (bytes) for the classes that share a bucket; one document stands for each class."""
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select(
        "class", F.col("first.doc_id").alias("id"), F.col("first.h").alias("hash")
    )
    text = docs.select(F.col("doc_id").alias("id"), _text_key(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("text"))
    safe = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))  # null ids meet, too
    joined = text.withColumn("id", safe).join(wanted.withColumn("id", safe), ["id", "hash"])
    return cut_lineage(joined.groupBy("class").agg(F.min("text").alias("text")))  # repeated rows


def _blocks(members: DataFrame, texts: DataFrame, size: int, percent: int, most_members: int, most_shingles: int) -> DataFrame:
    """``a, b``: links that join components inside a bucket, from ``members(band, key, class, n, root)``.

    A bucket is cut into blocks by hash; every pair of blocks is a group of its own, so a group stays small however large
    the bucket is. Inside, pairs that are already joined are passed over.
    """
    facts = members.groupBy("band", "key").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / most_members), F.ceil(F.sum("n") / most_shingles)).cast("int").alias("parts")
    )
    x = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    dealt = members.join(facts, ["band", "key"]).withColumn("x", x).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", "key", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "class", "root")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, size) for t in rows["text"]]
        names, roots = list(rows["class"]), list(rows["root"])
        top: dict = {r: r for r in roots}

        def find(r):
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        out, start = [], 0
        for at, i in enumerate(order):
            while 100 * len(sets[order[start]]) < percent * len(sets[i]):
                start += 1  # smaller sets cannot reach the similarity
            for j in order[start:at]:
                a, b = find(roots[i]), find(roots[j])
                if a != b and similar(sets[i], sets[j], percent):
                    top[a] = b
                    out.append((names[i], names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.join(texts, "class").groupBy("band", "key", "lo", "hi").applyInPandas(compare, "a binary, b binary")


def _links(docs: DataFrame, classes: DataFrame, size: int, percent: int, most_members: int, most_shingles: int) -> DataFrame:
    """``node, root`` over the linked classes."""
    buckets, members = _buckets(classes)
    texts = _texts(docs, classes, members)
    sized = classes.select(F.col("class").alias("pivot"), F.col("n").alias("pivot_n"))
    pairs = members.filter("class <> pivot").select("class", "n", "pivot").distinct().join(sized, "pivot")
    pairs = pairs.filter(_sizes_allow(F.col("n"), F.col("pivot_n"), percent))
    both = pairs.join(texts, "class").join(texts.select(F.col("class").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    links = cut_lineage(both.filter(confirmed(size, percent)("text", "pivot_text")).select(F.col("class").alias("a"), F.col("pivot").alias("b")))
    roots = cut_lineage(components(links))
    named = members.filter("class <> pivot").join(roots, members["class"] == roots["node"], "left").select(
        "band", "key", "class", "n", F.coalesce("root", "class").alias("root")
    )
    apart = named.groupBy("band", "key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("band", "key")
    more = cut_lineage(_blocks(cut_lineage(named.join(apart, ["band", "key"], "left_semi")), texts, size, percent, most_members, most_shingles))
    return roots if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 25, rows: int = 5,
    most_members: int = 512, most_shingles: int = 500_000,
) -> DataFrame:
    """``doc_id, h, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``; h hashes the text.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets; ``component_id`` is the
    smallest non-null doc_id of the component (null where it has none), ``kept`` tells whether it is the row's own. A
    null, empty or blank text has no shingles, is linked with nothing and is its own component. Equal texts and rows of
    one doc_id are linked by their texts like others; an empty table gives no rows; other columns are left out.
    ``bands`` of ``rows`` coordinates propose pairs: at 0.8 a single pair is missed with probability (1 - 0.8^5)^25, 5e-5.
    """
    marked = _rows(docs, shingle, bands, rows)
    full = marked.filter(F.col("class").isNotNull())
    classes = cut_lineage(full.groupBy("class").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("first"), F.min("n").alias("n"), F.min("bands").alias("bands")
    ))
    roots = _links(docs, classes, shingle, percent, most_members, most_shingles)
    named = cut_lineage(classes.join(roots, classes["class"] == roots["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = full.join(named.join(ids, "root").select("class", "component_id"), "class").select("doc_id", "h", "n", "component_id")
    empty = marked.filter(F.col("class").isNull()).select("doc_id", "h", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).select(
        "doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The kept documents with all their columns: one row per doc_id and text, the least by its plain columns."""
    text, ident = unused(docs.columns, "h", "id")
    safe = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    winners = near_duplicates(docs, **settings).filter("kept").select(safe.alias(ident), F.col("h").alias(text)).distinct()
    marked = docs.withColumns({ident: safe, text: _text_key(F.col("text"))}).join(winners, [ident, text])
    plain = [F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    one = marked.groupBy(ident, text).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(*plain)).alias("row"))
    return one.select("row.*")
