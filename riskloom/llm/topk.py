"""Exact top-k inner products over a pivot-distance index.

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm; a query gets 0 there. Then the inner
product is (|q|^2 + M - d^2) / 2 for the Euclidean distance d, and the triangle inequality bounds it: a vector at
distance r from a pivot has d >= |d(q, pivot) - r|. The index keys every vector by its nearest pivot and its distance
to it, sorted into rings of a few dozen rows. A ring also keeps the least and greatest distance of its rows to some
reference pivots; the closest of these annuli decides the ring's bound.

A query first scans the rings of the best bounds until they hold enough rows, which gives a threshold. Rings whose
bound reaches it are then expanded block by block, best bound first: every ring scanned may raise the query's
threshold, and a ring whose bound is below it is left out. Ties count, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

#: Stands for "no row yet". Orders use ~score, which, unlike -score, also turns the least number round.
_NONE = np.iinfo(np.int64).min
_QUERIES_AT_ONCE = 256


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, v``: components floor(scale * x); rows with a null vector or a null or non-finite component go."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.filter(F.col(key).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(key).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v")
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Float64 matrix; shorter vectors are filled with zeros, which leaves inner products as they are."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _scores(q: pd.Series, v: pd.Series, width: int) -> np.ndarray:
    """Integer inner products: through floats where these are exact, else through Python integers."""
    a, b = _matrix(q, width), _matrix(v, width)
    if a.size and b.size and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2.0**52:
        return (a @ b.T).astype(np.int64)
    to = lambda rows: [[int(c) for c in r] + [0] * (width - len(r)) for r in rows]
    return np.array([[sum(x * y for x, y in zip(r, s)) for s in to(v)] for r in to(q)], dtype=np.int64).reshape(len(q), len(v))


def _lifted(a: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([a, np.sqrt(np.maximum(most - (a * a).sum(axis=1, keepdims=True), 0))])


class Pivots:
    """Pivot points in the lifted space, and the rings around them (at most pivots x rings entries).

    A ring is known by its place in ``names``; ``blocks`` holds its block, ``low`` and ``high`` its distances to its own
    pivot (first column) and to the reference pivots.
    """

    def __init__(self, points: np.ndarray, most: float, width: int, references: int):
        self.points, self.most, self.width = points, most, width
        self.references = _far_apart(points, references)

    def with_rings(self, names: np.ndarray, pivot: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, block: int):
        self.names, self.pivot, self.sizes, self.low, self.high = names, pivot, sizes, low, high
        held, at = 0, 0
        blocks = []
        for n in sizes.tolist():  # consecutive rings up to ``block`` rows; a larger ring is a block that is split
            if held and held + n > block:
                held, at = 0, at + 1
            blocks.append(at)
            held += n
        self.blocks = np.array(blocks, dtype=np.int32)
        return self

    def distances(self, a: np.ndarray) -> np.ndarray:
        square = (a * a).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * a @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def bounds(self, a: np.ndarray, rings: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(queries, rings): no row of the ring scores above this; a margin covers rounding."""
        d = self.distances(np.hstack([a, np.zeros((len(a), 1))]))
        low, high = self.low[rings], self.high[rings]
        gap = np.zeros((len(a), len(low)))
        for n, anchor in enumerate([self.pivot[rings], *self.references]):
            to = d[:, anchor] if n == 0 else d[:, [anchor]]
            off = np.maximum(low[:, n] - to, to - high[:, n]) - 1e-6 * (to + high[:, n] + 1)
            np.maximum(gap, off, out=gap)
        total = (a * a).sum(axis=1)[:, None] + self.most
        return (total - gap * gap) / 2 + 1e-9 * total + 1


def _far_apart(points: np.ndarray, n: int) -> list[int]:
    """Places of up to ``n`` points, each the farthest from those before it."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def build(
    vectors: DataFrame, pivots: int | None = None, most_rings: int = 64, ring_rows: int = 16, references: int = 16, block: int = 2048
) -> tuple[DataFrame, Pivots] | None:
    """The index table ``vec_id, v, ring, block`` (every vector) and its pivots; None for an empty table.

    ``pivots`` (default: twice the root of the number of rows, at most 256) are the vectors with the smallest hash of id:
    the only part fitted on a sample. Each pivot's rows are cut into rings of about ``ring_rows`` rows, at most
    ``most_rings`` of them, at approximate quantiles of the distance; true least and greatest distances are then measured.
    The driver holds one entry per ring: 256 x 64 at most.
    """
    rows = cut_lineage(vectors)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("most")
    ).first()
    if facts["width"] is None:
        return None
    pivots = pivots or min(256, math.ceil(2 * math.sqrt(facts["n"])))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toPandas()["v"]
    width, most = facts["width"], facts["most"] * (1 + 1e-12)
    index = Pivots(np.unique(_lifted(_matrix(sample, width), most), axis=0), most, width, references)

    @F.pandas_udf("pivot int, dist double, refs array<double>")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            d = index.distances(_lifted(_matrix(v, width), most))
            at = d.argmin(axis=1)
            yield pd.DataFrame({"pivot": at.astype(np.int32), "dist": d[np.arange(len(d)), at], "refs": list(d[:, index.references])})

    keyed = cut_lineage(rows.withColumn("k", key("v")).select("vec_id", "v", "k.*"))
    shares = [i / most_rings for i in range(1, most_rings)]
    grid = F.percentile_approx("dist", shares, 1000) if shares else F.array().cast("array<double>")
    wanted = F.least(F.lit(most_rings), F.ceil(F.count(F.lit(1)) / ring_rows)).cast("int")
    cuts = keyed.groupBy("pivot").agg(grid.alias("grid"), wanted.alias("rings"))  # one row per pivot
    edges = cuts.withColumn("steps", F.when(F.col("rings") > 1, F.sequence(F.lit(1), F.col("rings") - 1)).otherwise(F.array().cast("array<int>"))).select(
        "pivot", F.transform("steps", lambda i: F.get("grid", F.floor(i * most_rings / F.col("rings")).cast("int") - 1)).alias("edges")
    )
    cut = keyed.join(F.broadcast(edges), "pivot").withColumn(
        "ring", (F.col("pivot") * most_rings + F.size(F.filter("edges", lambda e: e < F.col("dist")))).cast("int")
    )
    table = cut_lineage(cut.select("vec_id", "v", "ring", "dist", "refs"))
    annuli = [F.col("dist"), *[F.get("refs", F.lit(n)) for n in range(len(index.references))]]
    found = table.groupBy("ring").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(d) for d in annuli]).alias("low"), F.array(*[F.max(d) for d in annuli]).alias("high")
    ).orderBy("ring").collect()  # one row per ring
    names = np.array([r["ring"] for r in found], dtype=np.int32)
    low, high = (np.array([r[c] for r in found]) for c in ("low", "high"))
    index.with_rings(names, names // most_rings, np.array([r["n"] for r in found]), low, high, block)
    places = rows.sparkSession.createDataFrame(list(zip(names.tolist(), index.blocks.tolist())), "ring int, block int")
    return table.select("vec_id", "v", "ring").join(F.broadcast(places), "ring"), index


def _scan(visits: DataFrame, table: DataFrame, index: Pivots, k: int, block: int, queries_per_block: int) -> DataFrame:
    """Each query's k best per visited block: ``query_id, vec_id, score, seen``.

    ``visits``: ``query_id, q, least, block, rings``, the rings of the block that the query may need, and a score that
    a row has to reach. Blocks above ``block`` rows (rings of many equal distances) are split by hash, and many queries of
    a block are split into groups, so no task holds a whole ring. One row per query and part has a null ``vec_id`` and
    in ``seen`` the number of rows that the query was compared with.
    """
    spark = table.sparkSession
    held = pd.Series(index.sizes).groupby(index.blocks).sum()
    parts = spark.createDataFrame([(int(b), -(-int(n) // block)) for b, n in held.items()], "block int, parts int")
    groups = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / queries_per_block).cast("int").alias("groups"))
    dealt = cut_lineage(parts.join(groups, "block"))  # at most one row per block

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = visits.join(F.broadcast(dealt), "block").select(
        "query_id", "q", "least", "block", "rings", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("g"), every("parts").alias("b")
    )
    right = table.join(F.broadcast(dealt), "block").select(
        "vec_id", "v", "ring", "block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("b"), every("groups").alias("g")
    )
    width = index.width

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "seen": []}).astype("Int64")
        rows = rows.sort_values(["ring", "vec_id"], kind="stable").reset_index(drop=True)
        ids, qids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        rings, starts = np.unique(rows["ring"].to_numpy(), return_index=True)
        ends = np.r_[starts[1:], len(rows)]
        bound = index.bounds(_matrix(queries["q"], width), np.searchsorted(index.names, rings))
        bound[~np.array([np.isin(rings, r) for r in queries["rings"]])] = -np.inf
        least = queries["least"].to_numpy(dtype=float, na_value=-np.inf)
        top = np.full((len(queries), k), _NONE)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)
        seen = np.zeros(len(queries), dtype=np.int64)
        for r in np.argsort(-bound.max(axis=0), kind="stable"):
            asks = np.flatnonzero((bound[:, r] >= least) & (bound[:, r] > -np.inf))
            if not len(asks):
                continue
            here = slice(starts[r], ends[r])
            scores = _scores(queries["q"].iloc[asks], rows["v"].iloc[here], width)
            scores[ids[here][None, :] == qids[asks][:, None]] = _NONE
            seen[asks] += ends[r] - starts[r]
            first = np.argsort(~scores, axis=1, kind="stable")[:, :k]
            both = np.hstack([top[asks], np.take_along_axis(scores, first, axis=1)])
            names = np.hstack([who[asks], ids[here][first]])
            order = np.lexsort((names, ~both), axis=1)[:, :k]
            top[asks], who[asks] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
            least[asks] = np.maximum(least[asks], np.where(top[asks, -1] > _NONE, top[asks, -1].astype(float), -np.inf))
        at, place = np.nonzero(top > _NONE)
        good = pd.DataFrame({"query_id": qids[at], "vec_id": who[at, place], "score": top[at, place], "seen": 0})
        marks = pd.DataFrame({"query_id": qids, "vec_id": pd.NA, "score": 0, "seen": seen})
        return pd.concat([good.astype("Int64"), marks.astype("Int64")])

    keys = ["block", "b", "g"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score long, seen long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.filter(F.col("vec_id").isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidates(queries: DataFrame, table: DataFrame, index: Pivots, k: int = 10, block: int = 2048, queries_per_block: int = 1024) -> DataFrame:
    """What both scans found, as ``_scan`` gives it: the k best of a query are among its rows."""
    asked = cut_lineage(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"]))
    need = 4 * k + 1
    kind = "array<array<int>>"

    def by_block(places: np.ndarray) -> list[list[int]]:
        """Per block, its number and the names of the chosen rings."""
        places = np.sort(places)
        owner = index.blocks[places]
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(places) else []
        return [[int(owner[i]), *index.names[part].tolist()] for i, part in zip(at, np.split(places, at[1:]))] if len(places) else []

    def bounds(q: pd.Series) -> Iterator[np.ndarray]:
        for start in range(0, len(q), _QUERIES_AT_ONCE):
            yield from index.bounds(_matrix(q.iloc[start : start + _QUERIES_AT_ONCE], index.width))

    @F.pandas_udf(kind)
    def nearest_rings(q: pd.Series) -> pd.Series:
        orders = (np.argsort(-b, kind="stable") for b in bounds(q))
        return pd.Series([by_block(o[: int(np.searchsorted(np.cumsum(index.sizes[o]), need)) + 1]) for o in orders])

    @F.pandas_udf(kind)
    def further_rings(q: pd.Series, least: pd.Series, seen: pd.Series) -> pd.Series:
        low = least.to_numpy(dtype=float, na_value=-np.inf)
        low = np.where(np.isnan(low), -np.inf, low)
        out = []
        for b, t, lists in zip(bounds(q), low, seen):
            near = np.concatenate([np.asarray(part[1:]) for part in lists])
            out.append(by_block(np.flatnonzero((b >= t) & ~np.isin(index.names, near))))
        return pd.Series(out)

    def visits(found: DataFrame, lists: str) -> DataFrame:
        one = found.select("query_id", "q", "least", F.explode(lists).alias("part"))
        return cut_lineage(one.select("query_id", "q", "least", F.get("part", F.lit(0)).alias("block"), F.expr("slice(part, 2, size(part))").alias("rings")))

    first = cut_lineage(asked.withColumn("near", nearest_rings("q")))
    start = visits(first.withColumn("least", F.lit(None).cast("long")), "near")
    near = cut_lineage(_scan(start, table, index, k, block, queries_per_block))
    kth = _ranked(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    second = first.join(kth, "query_id", "left").withColumn("far", further_rings("q", "least", "near"))
    return near.unionByName(_scan(visits(second, "far"), table, index, k, block, queries_per_block))


def search(queries: DataFrame, table: DataFrame, index: Pivots, k: int = 10, **settings) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows per query, ties to the smaller vec_id.

    ``queries``: ``vec_id, v``. Rows with the query's own id take no part. Repeated ids each count as a row.
    """
    return _ranked(candidates(queries, table, index, k, **settings), k).select("query_id", "rank", "vec_id", "score")


def visited_share(found: DataFrame, table: DataFrame) -> float:
    """Share of all (query, row) pairs that ``candidates`` compared."""
    facts = found.agg(F.sum("seen").alias("seen"), F.count_distinct("query_id").alias("queries")).first()
    return (facts["seen"] or 0) / max(1, facts["queries"] * table.count())


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, block: int = 2048, **settings) -> DataFrame:
    """Top k of all ``vectors(vec_id, v)`` for the rows whose vec_id is divisible by ``every``."""
    built = build(vectors, block=block, **settings)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table, index = built
    return search(table.filter(F.col("vec_id") % every == 0), table, index, k, block=block)
