"""Exact k-nearest-neighbour join without comparing all pairs of rows.

1. Equal points are one row (point, number of members, first k+1 member keys), so a hot point is cheap.
2. Points are sorted into boxes by a small tree of median splits built from a sample of points; the
   sample only shapes the boxes. Every box keeps the true minimum and maximum of its points.
3. Each query looks into its own box first, which bounds its k-th distance, and then only
   into boxes closer than that bound, found by descending the tree of boxes. Boxes above a block size are
   compared block by block.
4. Inside a task a block's points lie in leaves of a few dozen; a query meets only leaves within its bound.
   Distances are computed in NumPy batches of bounded size; only k rows per query and block leave a task.

Distances are Euclidean; equal distances are broken by key, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.hashing import hash_order
from riskloom.operators.prefix import has_whole_number, with_key_numbers
from riskloom.session import cut_lineage, spread

MAX_BOXES = 4_096  # bounds the box table sent to every task (boxes x 2 x dimensions numbers)
BLOCK_POINTS = 8_192
BLOCK_QUERIES = 8_192
LEAF_POINTS = 64
_SAMPLE = 65_536
_BATCH = 1_024  # queries, and (query, leaf) pairs, that are compared at a time


def _points(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """Distinct points as (p, members, keys): at most k+1 smallest keys, enough for any k neighbours."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(key).cast("long").alias("key"), vector.alias("p")).filter(
        ~F.exists("p", lambda x: x.isNull())
    )
    # a bounded number of smallest keys per salt, then per point: no task holds a hot point's members
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(256)))
    first = Window.partitionBy("p", "salt").orderBy("key")
    few = salted.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1)
    members = few.groupBy("p").agg(F.slice(F.sort_array(F.collect_list("key")), 1, k + 1).alias("keys"))
    return members.filter(F.size("keys") > 0)


def _boxes(points: DataFrame, n_points: int, dims: int) -> list[tuple[int, float, int, int]]:
    """Split tree as (dimension, cut, left, right) nodes; a negative child -b-1 is box b."""
    wanted = int(min(MAX_BOXES, max(1, n_points // BLOCK_POINTS * 2)))
    if wanted == 1:
        return []
    share = min(1.0, 2.0 * _SAMPLE / n_points)
    cut = int(share * (1 << 60))
    text = F.array_join(F.transform("p", lambda x: x.cast("string")), ",")
    sample = points.filter(hash_order(text, "boxes") < F.lit(cut)).select("p").limit(2 * _SAMPLE)
    values = np.array([r.p for r in sample.collect()], dtype=float).reshape(-1, dims)
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, boxes: int) -> int:
        nonlocal count
        if boxes > 1 and len(rows) > 1:
            spread = rows.max(axis=0) - rows.min(axis=0)
            d = int(np.argmax(spread))
            if spread[d] > 0:
                middle = float(np.median(rows[:, d]))
                left = rows[:, d] < middle
                if not left.any():  # more than half share the lowest value
                    middle = float(rows[rows[:, d] > rows[:, d].min(), d].min())
                    left = rows[:, d] < middle
                place = len(nodes)
                nodes.append((d, middle, 0, 0))
                a = grow(rows[left], boxes // 2)
                b = grow(rows[~left], boxes - boxes // 2)
                nodes[place] = (d, middle, a, b)
                return place
        count += 1
        return -count

    grow(values, wanted)
    return nodes


def _box_of(nodes) -> Column:
    @F.pandas_udf(T.IntegerType())
    def locate(p: pd.Series) -> pd.Series:
        x = np.array(p.tolist(), dtype=float)
        at = np.zeros(len(x), dtype=int)
        if not nodes or not len(x):
            return pd.Series(at)
        table = np.array(nodes, dtype=float)
        open_rows = np.arange(len(x))
        while len(open_rows):
            node = table[at[open_rows]]
            go_left = x[open_rows, node[:, 0].astype(int)] < node[:, 1]
            at[open_rows] = np.where(go_left, node[:, 2], node[:, 3]).astype(int)
            open_rows = open_rows[at[open_rows] >= 0]
        return pd.Series(-at - 1)

    return locate("p")


def _matrix(p: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate(p.tolist()).astype(float).reshape(-1, dims) if len(p) else np.zeros((0, dims))


def _leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the points in leaves of at most ``size``, by median splits along the widest side."""
    parts = [np.arange(len(p))]
    while max(len(r) for r in parts) > size:
        halves = []
        for rows in parts:
            x = p[rows]
            half = len(rows) // 2
            order = np.argpartition(x[:, np.argmax(np.ptp(x, axis=0))], half)
            halves += [rows[order[:half]], rows[order[half:]]]
        parts = halves
    return parts


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of points to boxes (last axis: dimensions); rounding never lifts it above a point's inside."""
    total = 0.0
    for j in range(x.shape[-1]):
        off = np.maximum(np.maximum(low[..., j] - x[..., j], x[..., j] - high[..., j]), 0.0)
        total = total + off * off
    return total


def _starts(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per row the value at the start of its run."""
    return values[new][np.cumsum(new) - 1]


def _search(
    q: np.ndarray, own: np.ndarray, reach: np.ndarray, p: np.ndarray, members: list[np.ndarray], k: int, skip_self: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, key, d2): of every query its k nearest members of the points, none farther than ``reach``.

    The points lie in small leaves; a query meets the leaves that are nearer than the k-th point of its nearest leaf.
    """
    want, dims = (k + 1 if skip_self else k), p.shape[1]
    counts = np.array([len(m) for m in members])
    first, keys = np.cumsum(counts) - counts, np.concatenate(members).astype(np.int64)
    leaves = _leaves(p, max(LEAF_POINTS, 2 * want))
    width = max(len(r) for r in leaves)
    table = np.full((len(leaves), width), len(p))
    for i, rows in enumerate(leaves):
        table[i, : len(rows)] = rows
    padded = np.vstack([p, np.full((1, dims), np.inf)])
    at = [padded[table, j] for j in range(dims)]
    low = np.array([np.fmin.reduce(p[r]) for r in leaves])[None]
    high = np.array([np.fmax.reduce(p[r]) for r in leaves])[None]

    def distances(x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        d2 = np.zeros((len(x), width))
        for j in range(dims):  # exact differences: equal points give distance 0
            d2 += (x[:, j, None] - at[j][leaf]) ** 2
        return d2

    out = []
    for start in range(0, len(q), _BATCH):
        x, limit = q[start : start + _BATCH], reach[start : start + _BATCH]
        gap = _gap(x[:, None, :], low, high)
        if want <= width:
            near = distances(x, gap.argmin(axis=1))
            limit = np.fmin(limit, np.partition(near, want - 1, axis=1)[:, want - 1])
        row, leaf = np.nonzero(gap <= limit[:, None])
        found = []
        for a in range(0, len(row), _BATCH):
            i, l = row[a : a + _BATCH], leaf[a : a + _BATCH]
            d2 = distances(x[i], l)
            r, c = np.nonzero((d2 <= limit[i][:, None]) & (table[l] < len(p)))
            found.append((i[r], table[l[r], c], d2[r, c]))
        if not found:
            continue
        i, point, d2 = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((d2, i))
        i, point, d2 = i[order], point[order], d2[order]
        place = np.arange(len(i))
        query = np.diff(i, prepend=-1) != 0
        run = query | (np.diff(d2, prepend=-1.0) != 0)
        # points, not members, are counted: where keys repeat, several members may be the query's own
        keep = _starts(run, place) - _starts(query, place) < want
        i, point, d2 = i[keep], point[keep], d2[keep]
        n = counts[point]
        key = keys[np.repeat(first[point] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        i, d2 = np.repeat(i, n), np.repeat(d2, n)
        if skip_self:
            other = key != own[start + i]
            i, key, d2 = i[other], key[other], d2[other]
        order = np.lexsort((key, d2, i))
        i, key, d2 = i[order], key[order], d2[order]
        place = np.arange(len(i))
        keep = place - _starts(np.diff(i, prepend=-1) != 0, place) < k
        out.append((start + i[keep], key[keep], d2[keep]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out))


def _block_join(k: int, skip_self: bool, dims: int):
    """Top k of one block of queries against one block of points; bounded by both block sizes."""

    def join(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        own, neighbour, d2 = queries.key.to_numpy(), np.zeros(0, int), np.zeros(0)
        place = np.zeros(0, int)
        if len(queries) and len(points):
            q, p = _matrix(queries.p, dims), _matrix(points.p, dims)
            place, neighbour, d2 = _search(q, own, queries.reach.to_numpy(float), p, points["keys"].tolist(), k, skip_self)
        return pd.DataFrame({"key": own[place], "neighbour": neighbour, "d2": d2}).astype(
            {"key": "int64", "neighbour": "int64", "d2": "float64"}
        )

    return join


def _merge_top(candidates: DataFrame, k: int) -> DataFrame:
    """Best k per query. Each query has at most k rows per visited block, so groups stay small."""
    order = Window.partitionBy("key").orderBy("d2", "neighbour")
    return candidates.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def _visit(targets: DataFrame, blocks: DataFrame, sizes: DataFrame, k: int, skip_self: bool, dims: int) -> DataFrame:
    """Compare (key, p, box, reach) rows with all blocks of their box, splitting hot boxes on both sides."""
    split = (
        targets.join(sizes, "box")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("key"), F.col("n_parts")))
        .select("key", "p", "reach", "box", "block", "part")
    )
    copies = blocks.join(sizes.select("box", "n_parts"), "box").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1))
    ).select("p", "keys", "box", "block", "part")
    return (
        spread(split, "box", "block", "part").groupBy("box", "block", "part")
        .cogroup(spread(copies, "box", "block", "part").groupBy("box", "block", "part"))
        .applyInPandas(_block_join(k, skip_self, dims), "key long, neighbour long, d2 double")
    )


def _sizes(spark, n_points: dict[int, int], n_queries: dict[int, int]) -> DataFrame:
    """How many blocks and parts every box has that is visited."""
    rows = [(b, -(-n // (4 * BLOCK_POINTS)), max(1, -(-n_queries[b] // BLOCK_QUERIES))) for b, n in n_points.items() if b in n_queries]
    return spark.createDataFrame(rows, "box int, n_blocks int, n_parts long")


class _BoxTree:
    """Bounds of all boxes and of the split nodes above them: a query descends to the boxes within its reach."""

    def __init__(self, nodes, bounds, dims: int):
        self.inner, boxes = len(nodes), max(b.box for b in bounds) + 1
        self.low, self.high = np.full((self.inner + boxes, dims), np.inf), np.full((self.inner + boxes, dims), -np.inf)
        self.size = np.zeros(boxes, dtype=np.int64)
        for b in bounds:
            at = self.inner + b.box
            self.low[at], self.high[at], self.size[b.box] = np.array(b.low, float), np.array(b.high, float), b.n
        self.child = np.array([[c if c >= 0 else self.inner - c - 1 for c in n[2:]] for n in nodes]).reshape(-1, 2)
        for i in reversed(range(self.inner)):  # children have larger places than their node
            inside = [c for c in self.child[i] if c < len(self.low)]
            self.low[i] = np.fmin.reduce(self.low[inside]) if inside else np.inf
            self.high[i] = np.fmax.reduce(self.high[inside]) if inside else -np.inf

    def far_reach(self, x: np.ndarray, want: int) -> np.ndarray:
        """A distance within which every row has ``want`` points, from the farthest corners of the nearest boxes."""
        low, high = self.low[self.inner :][self.size > 0], self.high[self.inner :][self.size > 0]
        size, out = self.size[self.size > 0], np.full(len(x), np.inf)
        for i, row in enumerate(x):
            far = (np.maximum(np.abs(row - low), np.abs(row - high)) ** 2).sum(axis=1) * (1 + 1e-9)
            order = np.argsort(far)
            enough = np.searchsorted(np.cumsum(size[order]), want)
            if enough < len(far):
                out[i] = far[order[enough]]
        return out

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, box) of all boxes not farther than the row's reach, by rows."""
        row, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        rows, boxes = [], []
        while len(row):
            known = at < len(self.low)
            row, at = row[known], at[known]
            near = _gap(x[row], self.low[at], self.high[at]) <= reach[row]
            row, at = row[near], at[near]
            leaf = at >= self.inner
            rows.append(row[leaf])
            boxes.append(at[leaf] - self.inner)
            row, at = np.repeat(row[~leaf], 2), self.child[at[~leaf]].reshape(-1)
        row, box = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (rows, boxes))
        order = np.lexsort((box, row))
        return row[order], box[order]


def _finished(best: DataFrame) -> DataFrame:
    return best.select("key", "neighbour", "d2", F.sqrt("d2").alias("distance"), "position")


def knn_join(
    queries: DataFrame, points: DataFrame, key: str, columns: Sequence[str], k: int, skip_self: bool = False
) -> DataFrame:
    """(key, neighbour, d2, distance, position): the exact k nearest points of every query row.

    Rows with a missing coordinate take no part. ``skip_self`` leaves out a query's own key. Keys that are no
    whole numbers are numbered in text order for the search and come back as texts.
    """
    if not (has_whole_number(queries, key) and has_whole_number(points, key)):
        asked, stored = with_key_numbers([queries, points], key)
        near = knn_join(asked, stored, "_code", columns, k, skip_self)
        own = asked.select(F.col("_code").alias("key"), F.col(key).cast("string").alias("_own")).distinct()
        other = stored.select(F.col("_code").alias("neighbour"), F.col(key).cast("string").alias("_other")).distinct()
        named = near.join(own, "key").join(other, "neighbour")
        return named.select(
            F.col("_own").alias("key"), F.col("_other").alias("neighbour"), "d2", "distance", "position"
        )
    dims = len(columns)
    donors = cut_lineage(_points(points, key, columns, k))
    n_points = donors.count()
    nodes = _boxes(donors, n_points, dims)
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    asked = queries.select(F.col(key).cast("long").alias("key"), vector.alias("p")).filter(
        ~F.exists("p", lambda x: x.isNull())
    )
    spark = queries.sparkSession
    endless = F.lit(float("inf"))
    if not nodes:  # few distinct points: one box, one visit
        sizes = _sizes(spark, {0: max(1, n_points)}, {0: asked.count()})
        n_blocks = -(-max(1, n_points) // (4 * BLOCK_POINTS))
        hashed = F.pmod(F.xxhash64("p"), F.lit(n_blocks)).cast("int")
        blocks = donors.select("p", "keys", F.lit(0).alias("box"), hashed.alias("block"))
        near = _visit(asked.withColumns({"box": F.lit(0), "reach": endless}), blocks, sizes, k, skip_self, dims)
        return _finished(_merge_top(near, k))
    boxed = cut_lineage(
        donors.withColumn("box", _box_of(nodes)).withColumn("h", F.pmod(F.xxhash64("p"), F.lit(1 << 20)))
    )
    start = cut_lineage(asked.withColumn("box", _box_of(nodes)))
    inside = lambda j: F.when(~F.isnan(F.col("p")[j]), F.col("p")[j])
    bounds = boxed.groupBy("box").agg(
        F.count("*").alias("n"),
        F.array(*[F.min(inside(j)) for j in range(dims)]).alias("low"),
        F.array(*[F.max(inside(j)) for j in range(dims)]).alias("high"),
    ).collect()  # one row per box, at most MAX_BOXES
    if not bounds:
        return spark.createDataFrame(
            [], "key long, neighbour long, d2 double, distance double, position int"
        )
    n_in = {b.box: b.n for b in bounds}
    n_blocks = spark.createDataFrame([(b, -(-n // (4 * BLOCK_POINTS))) for b, n in n_in.items()], "box int, n_blocks int")
    blocks = boxed.join(n_blocks, "box").withColumn(
        "block", (F.col("h") % F.col("n_blocks")).cast("int")
    ).select("p", "keys", "box", "block")
    tree = _BoxTree(nodes, bounds, dims)

    @F.pandas_udf("struct<reach:double,others:array<int>>")
    def closer_boxes(p: pd.Series, done: pd.Series, bound: pd.Series) -> pd.DataFrame:
        x, reach = _matrix(p, dims), bound.fillna(np.inf).to_numpy(dtype=float).copy()
        if not skip_self:  # a query's own key may be at any number of points
            lost = np.flatnonzero(np.isinf(reach))
            reach[lost] = tree.far_reach(x[lost], k)
        others = []
        for at in range(0, len(x), 1024):
            row, box = tree.within(x[at : at + 1024], reach[at : at + 1024])
            new = box != done.to_numpy()[at + row]
            row, box = row[new], box[new].astype(np.int32)
            others += np.split(box, np.searchsorted(row, np.arange(1, len(x[at : at + 1024]))))
        return pd.DataFrame({"reach": reach, "others": others})

    counted = lambda df: {r.box: r.n for r in df.groupBy("box").agg(F.count("*").alias("n")).collect()}
    sizes = _sizes(spark, n_in, counted(start))
    first = cut_lineage(_merge_top(_visit(start.withColumn("reach", endless), blocks, sizes, k, skip_self, dims), k))
    bound = first.groupBy("key").agg(F.count("*").alias("n"), F.max("d2").alias("d2"))
    # as many rows as queries on both sides: joined without a copy on the driver, whatever the size of the packed files
    open_rows = start.join(bound.hint("merge"), "key", "left").withColumn(
        "s", closer_boxes("p", "box", F.when(F.col("n") >= k, F.col("d2")).otherwise(endless))
    )
    rest = cut_lineage(open_rows.select("key", "p", "s.reach", "s.others").filter(F.size("others") > 0))
    further = rest.select("key", "p", "reach", F.explode("others").alias("box"))
    sizes = _sizes(spark, n_in, counted(further))
    second = _visit(further, blocks, sizes, k, skip_self, dims)
    best = _merge_top(first.drop("position").unionByName(second), k)
    return _finished(best)


def knn_vote(
    train: DataFrame, test: DataFrame, key: str, columns: Sequence[str], label: str, k: int = 5
) -> DataFrame:
    """(key, probability): share of label 1 among the k nearest training rows."""
    near = knn_join(test, train, key, columns, k)
    own = "long" if has_whole_number(train, key) and has_whole_number(test, key) else "string"
    labels = train.select(F.col(key).cast(own).alias("neighbour"), F.col(label).cast("double").alias("y"))
    return near.join(labels.hint("merge"), "neighbour").groupBy("key").agg(F.avg("y").alias("probability"))
