"""Isolation forest: trees grown on small hashed samples, one task per tree; scoring is a projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.hashing import HASH_SPACE
from riskloom.operators.quantiles import quantiles
from riskloom.session import cut_lineage

SAMPLE = 256


def _mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list, place: int) -> None:
    """Nodes are (feature, cut, left, right, path length); leaves have feature -1."""
    low, high = x.min(axis=0), x.max(axis=0)
    open_features = np.flatnonzero(high > low)
    if depth >= limit or len(x) <= 1 or not len(open_features):
        nodes[place] = (-1, 0.0, 0, 0, depth + _mean_path(len(x)))
        return
    j = int(rng.choice(open_features))
    cut = float(rng.uniform(low[j], high[j]))
    left = x[:, j] < cut
    a, b = len(nodes), len(nodes) + 1
    nodes += [None, None]
    nodes[place] = (j, cut, a, b, 0.0)
    _grow(x[left], rng, depth + 1, limit, nodes, a)
    _grow(x[~left], rng, depth + 1, limit, nodes, b)


def hash_below(key: Column, seed: str, cut: int) -> Column:
    """``hash_order(key, seed) < cut`` on the digits themselves: nothing is turned into a number, row by row and tree by tree."""
    if cut >= HASH_SPACE:
        return key.isNotNull()
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))) < F.lit(f"{cut:015x}")


def fit_forest(
    df: DataFrame, key: Column, columns: Sequence[str], trees: int = 100, seed: int = 42
) -> tuple[list[list[tuple]], int]:
    """Trees as node lists (bounded: trees x 2 x 256 nodes) and the sample size.

    Each tree sees about 256 rows whose hash falls into its slice, so sampling is one scan.
    """
    rows = df.select(key.alias("k"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    n = rows.count()
    if n == 0:
        return [], 0
    size = min(SAMPLE, n)
    # the hash of (row, tree) is compared with the share; slightly more are drawn, then cut to size
    share = min(1.0, 1.3 * size / n)
    draws = [
        F.when(hash_below(F.col("k"), f"{seed}-tree-{t}", int(share * HASH_SPACE)), F.lit(t))
        for t in range(trees)
    ]
    picked = rows.withColumn("tree", F.explode(F.array_compact(F.array(*draws))))
    return _grow_forest(picked, columns, size, seed), size


def _grow_forest(picked: DataFrame, columns: Sequence[str], size: int, seed: int) -> list[list[tuple]]:
    """Grow one tree per ``tree`` id from rows (k, tree, columns); groups hold a few hundred rows."""
    order = Window.partitionBy("tree").orderBy(F.xxhash64("k", "tree"))
    sample = picked.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= size)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf.tree.iloc[0])])
        nodes: list = [None]
        x = pdf.sort_values("i")[list(columns)].to_numpy(dtype=float)
        _grow(x, rng, 0, limit, nodes, 0)
        flat = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        flat["tree"] = int(pdf.tree.iloc[0])
        flat["node"] = np.arange(len(flat))
        return flat

    schema = "feature int, cut double, left int, right int, path double, tree int, node int"
    grown = sample.groupBy("tree").applyInPandas(grow, schema).orderBy("tree", "node").collect()
    forest: dict[int, list[tuple]] = {}
    for r in grown:
        forest.setdefault(r.tree, []).append((r.feature, r.cut, r.left, r.right, r.path))
    return list(forest.values())


def _sunk(nodes: list[tuple]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, and per node the feature, the cut, both children (a leaf is its own) and the path length."""
    feature, cut, left, right, path = (np.array(v) for v in zip(*nodes))
    leaf, own = feature < 0, np.arange(len(nodes))
    child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).reshape(-1).astype(np.int64)
    depth, level = 0, [0]
    while level := [c for n in level if not leaf[n] for c in (left[n], right[n])]:
        depth += 1
    return depth, np.where(leaf, 0, feature).astype(np.int64), cut.astype(float), child, path.astype(float)


def anomaly_score(forest: list[list[tuple]], size: int, columns: Sequence[Column]) -> Column:
    """2 ** (-mean path / expected path): near 1 is unusual. Null when a coordinate is missing."""
    tables = [_sunk(t) for t in forest]
    scale = _mean_path(size) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(p: pd.Series) -> pd.Series:
        known = p.notna().to_numpy()
        out = np.full(len(p), np.nan)
        if known.any():
            x = np.array(p[known].tolist(), dtype=float)
            usable = ~np.isnan(x).any(axis=1)
            total = np.zeros(len(x))
            row = np.arange(len(x))
            for depth, feature, cut, child, path in tables:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):  # a leaf leads to itself
                    at = child[2 * at + (x[row, feature[at]] >= cut[at])]
                total += path[at]
            value = 2.0 ** (-(total / len(tables)) / scale)
            value[~usable] = np.nan
            out[known] = value
        return pd.Series(out).where(~np.isnan(out), None)

    return score(F.array(*[c.cast("double") for c in columns]))


def forest_classifier(
    df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.1, trees: int = 200, seed: int = 42
) -> DataFrame:
    """(key, anomaly, predicted, probability): cut at the contamination quantile, logistic of the margin."""
    forest, size = fit_forest(df, F.col(key), columns, trees, seed)
    # scored once: the quantile reads the scores several times
    scored = cut_lineage(df.select(key, anomaly_score(forest, size, [F.col(c) for c in columns]).alias("anomaly")))
    cut = quantiles(scored, ["anomaly"], [1 - contamination])["anomaly"][0]
    margin = F.lit(cut) - F.col("anomaly")  # positive for ordinary rows
    return scored.withColumns(
        {
            "predicted": (margin < 0).cast("int"),
            "probability": 1 / (1 + F.exp(margin)),
        }
    )


def fit_column_forest(df: DataFrame, fitted) -> None:
    """One-column forest for the outlier dispatcher; skipped below ten values."""
    column = fitted.column
    present = df.filter(F.col(column).isNotNull())
    n = present.count()
    if n < 10:
        return
    # equal values are counted first: a hot value enters a tree by a Poisson draw of its count
    size, trees, seed = min(SAMPLE, n), 100, 42
    share = min(1.0, 1.3 * size / n)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def drawn(k: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for cell, count in zip(k, n):
            rng = np.random.default_rng([seed, int(cell) & 0xFFFFFFFFFFFFFFFF])
            out.append(np.repeat(np.arange(trees), rng.poisson(count * share, trees)).tolist())
        return pd.Series(out)

    value = F.col(column).cast("double").alias(column)
    cells = present.groupBy(value).agg(F.count("*").alias("n")).withColumn("k", F.xxhash64(column))
    picked = cells.select("k", column, F.explode(drawn("k", "n")).alias("tree"))
    forest = _grow_forest(picked, [column], size, seed)
    scorer = lambda x: anomaly_score(forest, size, [x])
    scored = present.select(scorer(F.col(column)).alias("anomaly"))
    fitted.score_cut = quantiles(scored, ["anomaly"], [1 - fitted.rule.contamination])["anomaly"][0]
    fitted.scorer = scorer
