"""KNN imputation over incomplete points: one index and one search for all patterns of missing cells.

The squared distance of two points is (all coordinates / shared coordinates) times the sum over the shared ones. Donors
that are equal in every cell are one point with its first keys; rows with equal cells are asked once. Points are sorted
into boxes by a small split tree made from a sample (a missing coordinate goes to the right). A box keeps, per
coordinate, the range of its present values, whether every point has it, and how many do. For a query the least possible
distance to a box takes the coordinates that all its points share, and of the others those that lower the mean: masked
coordinates are skipped, and the bound still holds for every point. A query first visits its nearest boxes until every
missing column has k donors, then all boxes whose bound reaches the k-th distance of some column. Each visit measures a
block of points once for all missing columns of the query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.hashing import hash_order
from riskloom.operators import knn
from riskloom.operators.prefix import has_whole_number, with_key_numbers
from riskloom.session import cut_lineage, spread

_FOUND = "q long, at int, d2 double, neighbour long, v double"


def _cells(columns: Sequence[str]) -> Column:
    """The row's numbers as an array; NaN is missing, and zero has one sign, so that equal rows are equal."""
    value = lambda c: F.col(c).cast("double")
    return F.array(*[F.when(~F.isnan(value(c)), value(c) + F.lit(0.0)) for c in columns])


def _points(donors: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """Distinct points as (p, keys) with their k smallest keys; a hot point is combined per salt first."""
    rows = donors.select(F.col(key).cast("long").alias("key"), _cells(columns).alias("p"))
    rows = rows.filter(F.exists("p", lambda x: x.isNotNull())).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(256)))
    first = Window.partitionBy("p", "salt").orderBy("key")
    few = rows.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k)
    return few.groupBy("p").agg(F.slice(F.sort_array(F.collect_list("key")), 1, k).alias("keys"))


def _matrix(points: pd.Series, dims: int) -> np.ndarray:
    return np.array(points.tolist(), dtype=float).reshape(-1, dims)


def _tree(points: DataFrame, n: int, dims: int) -> list[tuple[int, float, int, int]]:
    """Split nodes as in ``knn``: (dimension, cut, left, right), a negative child -b-1 is box b."""
    wanted = int(min(knn.MAX_BOXES, max(1, n // knn.BLOCK_POINTS * 2)))
    if wanted == 1:
        return []
    text = F.array_join(F.transform("p", lambda x: x.cast("string")), ",", "-")
    share = int(min(1.0, 2.0 * knn._SAMPLE / n) * (1 << 60))
    sample = points.filter(hash_order(text, "boxes") < F.lit(share)).select("p").limit(2 * knn._SAMPLE)
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, boxes: int) -> int:
        nonlocal count
        if boxes > 1 and len(rows) > 1:
            known = ~np.isnan(rows)
            low, high = np.where(known, rows, np.inf).min(axis=0), np.where(known, rows, -np.inf).max(axis=0)
            width = np.where(high > low, high - low, 0.0) * known.mean(axis=0)
            d = int(np.argmax(width))
            if width[d] > 0:
                cut = float(np.nanmedian(rows[:, d]))
                left = rows[:, d] < cut
                if not left.any():  # more than half share the lowest value
                    cut = float(rows[rows[:, d] > low[d], d].min())
                    left = rows[:, d] < cut
                place = len(nodes)
                nodes.append((d, cut, 0, 0))
                a = grow(rows[left], boxes // 2)
                nodes[place] = (d, cut, a, grow(rows[~left], boxes - boxes // 2))
                return place
        count += 1
        return -count

    grow(_matrix(sample.toPandas()["p"], dims), wanted)
    return nodes


class _Boxes:
    """Bounds of every box (at most ``MAX_BOXES``)."""

    def __init__(self, rows: Sequence, dims: int):
        self.ids = np.array([r["box"] for r in rows], np.int32)
        self.low = np.array([[np.nan if v is None else v for v in r["low"]] for r in rows], float).reshape(-1, dims)
        self.high = np.array([[np.nan if v is None else v for v in r["high"]] for r in rows], float).reshape(-1, dims)
        self.held = np.array([r["held"] for r in rows], np.int64).reshape(-1, dims)
        self.sizes = np.array([r["n"] for r in rows], np.int64)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """(queries, boxes) least possible squared distance; infinite where no coordinate can be shared."""
        dims = x.shape[1]
        out = np.empty((len(x), len(self.ids)))
        every = self.held == self.sizes[:, None]
        some = self.held > 0
        for i, q in enumerate(x):
            known = ~np.isnan(q)
            gap = np.fmax(np.fmax(self.low - q, q - self.high), 0.0) ** 2
            fixed = every & known
            total, n = np.where(fixed, gap, 0.0).sum(axis=1), fixed.sum(axis=1)
            maybe = some & known & ~fixed
            free = np.sort(np.where(maybe, gap, np.inf), axis=1)  # nearest first
            for j in range(dims):
                usable = j < maybe.sum(axis=1)
                gain = np.where(usable, free[:, j], 0.0)
                lower = usable & ((n == 0) | (gain * n < total))
                total, n = np.where(lower, total + gain, total), n + lower
            out[i] = np.where(n > 0, dims * total / np.maximum(n, 1), np.inf)
        return out * (1 - 1e-12)


def _nearest(k: int, dims: int):
    """The k nearest donors of a block for every missing column of every query, measured once for all columns."""

    def of(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        parts: list[np.ndarray] = []
        if len(queries) and len(points):
            q, p = _matrix(queries["p"], dims), _matrix(points["p"], dims)
            names, sizes = queries["q"].to_numpy(np.int64), points["keys"].map(len).to_numpy()
            keys, starts = np.concatenate(points["keys"].tolist()), np.concatenate([[0], np.cumsum(sizes)])
            held = ~np.isnan(p)
            step = max(1, (1 << 22) // len(p))  # bounds the distance matrix
            for start in range(0, len(q), step):
                x = q[start : start + step]
                total, shared = np.zeros((len(x), len(p))), np.zeros((len(x), len(p)), np.int64)
                for j in range(dims):  # exact differences: equal cells give distance 0
                    both = ~np.isnan(x[:, j])[:, None] & held[None, :, j]
                    total += np.where(both, (x[:, j][:, None] - p[None, :, j]) ** 2, 0.0)
                    shared += both
                d2 = np.where(shared > 0, total * dims / np.maximum(shared, 1), np.inf)
                for at in range(dims):
                    asking, giving = np.flatnonzero(np.isnan(x[:, at])), np.flatnonzero(held[:, at])
                    if not len(asking) or not len(giving):
                        continue
                    part = d2[np.ix_(asking, giving)]
                    if len(giving) > k:
                        reach = np.partition(part, k - 1, axis=1)[:, k - 1]
                    else:
                        reach = np.full(len(part), np.inf)
                    row, column = np.nonzero((part <= reach[:, None]) & np.isfinite(part))
                    point = giving[column]
                    repeat = sizes[point]
                    row, found = np.repeat(row, repeat), np.repeat(part[row, column], repeat)
                    within = np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                    key = keys[np.repeat(starts[point], repeat) + within]
                    value = np.repeat(p[point, at], repeat)
                    order = np.lexsort((key, found, row))
                    row, found, key, value = row[order], found[order], key[order], value[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                    keep = place < k
                    parts.append((names[start + asking[row[keep]]], np.full(keep.sum(), at), found[keep], key[keep], value[keep]))
        if not parts:
            return pd.DataFrame({"q": [], "at": [], "d2": [], "neighbour": [], "v": []}).astype({"q": "int64", "at": "int32", "neighbour": "int64"})
        return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("q", "at", "d2", "neighbour", "v"))})

    return of


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "at").orderBy("d2", "neighbour")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def fills(queries: DataFrame, points: DataFrame, dims: int, k: int) -> DataFrame:
    """(q, at, fill): the mean of the k nearest donors' values for each missing cell of ``queries(q, p)``."""
    spark = queries.sparkSession
    n = points.count()
    nodes = _tree(points, n, dims)
    boxed = cut_lineage(points.withColumn("box", knn._box_of(nodes)))
    cell = lambda f: F.array(*[f(F.col("p")[j]) for j in range(dims)])
    bounds = boxed.groupBy("box").agg(F.count(F.lit(1)).alias("n"), cell(F.min).alias("low"), cell(F.max).alias("high"), cell(F.count).alias("held")).collect()
    if not bounds:
        return spark.createDataFrame([], "q long, at int, fill double")
    boxes = _Boxes(bounds, dims)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in batches:
            x, out = _matrix(p, dims), []
            for i, b in enumerate(boxes.bounds(x)):
                order = np.argsort(b, kind="stable")
                enough = np.cumsum(boxes.held[order][:, np.isnan(x[i])], axis=0) >= k
                whole = enough.all(axis=1)
                out.append(boxes.ids[order[: (int(whole.argmax()) if whole.any() else len(order) - 1) + 1]].tolist())
            yield pd.Series(out)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def further(p: pd.Series, seen: pd.Series, reach: pd.Series) -> pd.Series:
        limit = reach.fillna(np.inf).to_numpy()
        return pd.Series([np.setdiff1d(boxes.ids[b <= r], s).tolist() for b, s, r in zip(boxes.bounds(_matrix(p, dims)), seen, limit)])

    def visit(asked: DataFrame) -> DataFrame:
        """Blocks of a box against parts of its queries."""
        parts = asked.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / knn.BLOCK_QUERIES).cast("int").alias("parts"))
        sizes = spark.createDataFrame([(int(b), int(-(-s // knn.BLOCK_POINTS))) for b, s in zip(boxes.ids, boxes.sizes)], "box int, blocks int")
        dealt = cut_lineage(sizes.join(parts, "box"))
        left = asked.join(dealt, "box").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("q", "p", "box", "block", "part")
        right = boxed.join(dealt, "box").withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("p", "keys", "box", "block", "part")
        keys = ["box", "block", "part"]
        return spread(left, *keys).groupBy(*keys).cogroup(spread(right, *keys).groupBy(*keys)).applyInPandas(_nearest(k, dims), _FOUND)

    if len(boxes.ids) == 1:
        best = _best(visit(queries.withColumn("box", F.lit(int(boxes.ids[0])))), k)
    else:
        asked = cut_lineage(queries.withColumn("boxes", first("p")))
        near = cut_lineage(_best(visit(asked.select("q", "p", F.explode("boxes").alias("box"))), k))
        missing = F.size(F.filter("p", lambda x: x.isNull()))
        # the farthest k-th distance over the row's missing columns, if all of them have k donors already
        full = near.filter(F.col("place") == k).groupBy("q").agg(F.count(F.lit(1)).alias("full"), F.max("d2").alias("reach"))
        rest = asked.join(full, "q", "left").withColumn("reach", F.when(F.col("full") == missing, F.col("reach")))
        rest = cut_lineage(rest.select("q", "p", F.explode(further("p", "boxes", "reach")).alias("box")))
        best = _best(near.drop("place").unionByName(visit(rest)), k)
    return best.groupBy("q", "at").agg(F.avg("v").alias("fill"))


def knn_impute(
    df: DataFrame, key: str, columns: Sequence[str], k: int = 5, donors: DataFrame | None = None
) -> DataFrame:
    """Fill each missing cell with the mean of the k nearest donors that have the value; ties go to the smaller key.

    Distance over the coordinates both rows have, scaled up by (all / shared) coordinates. A cell for which no donor
    shares a coordinate gets the mean of its column. Null and NaN are missing.
    """
    donors = df if donors is None else donors
    if not (has_whole_number(df, key) and has_whole_number(donors, key)):
        coded, stored = with_key_numbers([df, donors], key)
        return knn_impute(coded, "_code", columns, k, stored).drop("_code")
    dims = len(columns)
    points = cut_lineage(_points(donors, key, columns, k))
    cells = _cells(columns)
    incomplete = df.select(cells.alias("p")).filter(F.exists("p", lambda x: x.isNull())).distinct()
    asked = cut_lineage(incomplete.withColumn("q", F.monotonically_increasing_id()))
    found = fills(asked.select("q", "p"), points, dims, k)
    wide = found.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("at", "fill"))).alias("_fills"))  # one entry per column
    rows = df.withColumn("_p", cells).join(asked.join(wide, "q").select(F.col("p").alias("_p"), "_fills"), "_p", "left")
    means = donors.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    filled = {
        c: F.coalesce(F.element_at("_p", i + 1), F.element_at("_fills", F.lit(i)), F.lit(means[f"m{i}"]))
        for i, c in enumerate(columns)
    }
    return rows.withColumns(filled).select(*df.columns)
