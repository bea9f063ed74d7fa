"""KNN imputation over incomplete points against brute force."""

import numpy as np
import pytest

from riskloom.operators import knn, masked


def brute(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    dims = x.shape[1]
    out = x.copy()
    for i in range(len(x)):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        n = both.sum(axis=1)
        d2 = np.where(n > 0, np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) * dims / np.maximum(n, 1), np.inf)
        for c in np.flatnonzero(np.isnan(x[i])):
            able = np.flatnonzero(~np.isnan(x[:, c]) & np.isfinite(d2))
            near = able[np.lexsort((ids[able], d2[able]))][:k]
            out[i, c] = x[near, c].mean() if len(near) else np.nanmean(x[:, c])
    return {int(i): o for i, o in zip(ids, out)}


def table(n, dims, gaps, levels, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, dims)).astype(float) + rng.integers(0, 3, (n, 1)) * levels
    hole = rng.random((n, dims)) < gaps
    rows = [(i, *[None if h else float(v) for v, h in zip(r, hole[i])]) for i, r in enumerate(x)]
    return rows + [(n, *[None] * dims), (n + 1, 1.0, *[None] * (dims - 1)), (n + 2, *rows[0][1:]), (n + 3, float("nan"), *rows[1][2:])]


@pytest.mark.parametrize("dims,gaps,levels,block", [(10, 0.3, 50, None), (4, 0.4, 3, None), (5, 0.3, 20, 32), (3, 0.2, 1000, 16)])
def test_imputation_equals_brute_force(spark, monkeypatch, dims, gaps, levels, block):
    if block:  # many boxes, blocks and parts
        monkeypatch.setattr(knn, "BLOCK_POINTS", block)
        monkeypatch.setattr(knn, "BLOCK_QUERIES", block)
    rows = table(400, dims, gaps, levels, dims)
    names = [f"c{i}" for i in range(dims)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    got = masked.knn_impute(frame, "id", names, 5).collect()
    want = brute([(r[0], *[None if v is not None and v != v else v for v in r[1:]]) for r in rows], 5)
    assert len(got) == len(rows)
    for r in got:
        assert [r[c] for c in names] == pytest.approx(list(want[r["id"]]), abs=1e-9)


def test_bounds_hold_for_incomplete_points():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4)) * 10
    x[rng.random(x.shape) < 0.4] = np.nan
    parts = np.where(np.isnan(x[:, 0]), 2, (x[:, 0] > 5).astype(int))
    rows = [
        {"box": b, "n": int((parts == b).sum()), "low": np.nanmin(x[parts == b], axis=0) if b < 2 else [None, *np.nanmin(x[parts == b][:, 1:], axis=0)],
         "high": np.nanmax(x[parts == b], axis=0) if b < 2 else [None, *np.nanmax(x[parts == b][:, 1:], axis=0)], "held": (~np.isnan(x[parts == b])).sum(axis=0)}
        for b in range(3)
    ]
    bounds = masked._Boxes(rows, 4).bounds(x)
    for i, q in enumerate(x):
        both = ~np.isnan(q) & ~np.isnan(x)
        n = both.sum(axis=1)
        d2 = np.where(n > 0, np.where(both, (x - q) ** 2, 0).sum(axis=1) * 4 / np.maximum(n, 1), np.inf)
        for b in range(3):
            assert bounds[i, b] <= d2[parts == b].min()
    assert (bounds > 0).any()


def test_other_donors_and_odd_tables(spark):
    schema = "id string, a double, b double"
    rows = spark.createDataFrame([("x", 1.0, None), ("y", None, None), (None, 2.0, None)], schema)
    donors = spark.createDataFrame([("p", 1.1, 10.0), ("q", 9.0, 20.0), ("r", None, 90.0)], schema)
    got = sorted((r["a"], r["b"]) for r in masked.knn_impute(rows, "id", ["a", "b"], 1, donors).collect())
    assert got == [(1.0, 10.0), (2.0, 10.0), (pytest.approx(5.05), 40.0)]
    assert masked.knn_impute(rows.limit(0), "id", ["a", "b"], 1, donors).count() == 0
    alone = masked.knn_impute(rows, "id", ["a", "b"], 1, donors.limit(0)).collect()
    assert all(r["b"] is None for r in alone)
