"""Kendall by rank digits, blocked co-moments, kernel margins and splittable csv against brute force."""

import itertools
import math

import numpy as np
import pytest

from riskloom.operators import association, oversample
from riskloom.sources import tables


def brute_tau(rows):
    s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s += np.sign(a - c) * np.sign(b - d)
        tx += a == c
        ty += b == d
    pairs = len(rows) * (len(rows) - 1) / 2
    under = (pairs - tx) * (pairs - ty)
    return s / math.sqrt(under) if under else None


@pytest.mark.parametrize("shape", ["distinct", "ties", "hot", "reversed", "constant", "gaps"])
def test_kendall_by_digits_equals_all_pairs(spark, shape):
    draw = np.random.default_rng(7)
    x, y = draw.permutation(400).astype(float), draw.permutation(400).astype(float)
    if shape == "ties":
        x, y = x // 40, y // 25
    if shape == "hot":
        x, y = np.where(x < 140, 5.0, x), np.where(y > 260, 300.0, y)
    if shape == "reversed":
        y = -x
    if shape == "constant":
        y = np.ones(400)
    rows = list(zip(x.tolist(), y.tolist()))
    table = rows + [(None, 1.0), (2.0, None), (float("nan"), 3.0)] if shape == "gaps" else rows
    got = association.kendall(spark.createDataFrame(table, "x double, y double"), "x", "y").first()
    want = brute_tau(rows)
    assert got.n == 400
    assert got.tau is None if want is None else got.tau == pytest.approx(want, abs=1e-12)


def test_kendall_of_an_empty_table(spark):
    got = association.kendall(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    assert got.tau is None and got.n is None


def test_co_moments_of_many_columns_equal_built_in_correlations(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(120, 90)) * 10.0 ** draw.integers(-3, 4, 90) + 1e6
    base[draw.random(base.shape) < 0.2] = np.nan
    base[:, 5] = 4.0  # constant
    base[:, 6] = np.nan  # empty
    names = [f"v{i}" for i in range(90)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.a, r.b): r for r in association.pearson_pairs(df, names).collect()}
    assert len(got) == 90 * 89 // 2
    for i, j in itertools.combinations(range(90), 2):
        held = ~np.isnan(base[:, i]) & ~np.isnan(base[:, j])
        r = got[names[i], names[j]]
        assert r.n == held.sum()
        if {5, 6} & {i, j}:
            assert r.r is None
        else:
            x, y = base[held, i] - 1e6, base[held, j] - 1e6
            assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)


def test_margin_seeds_lie_at_the_edge_of_a_ring(spark):
    """Minority inside, majority around it: a straight margin has no edge here, a Gaussian one has."""
    draw = np.random.default_rng(11)
    angle = draw.uniform(0, 2 * np.pi, 900)
    radius = np.r_[np.sqrt(draw.random(300)), np.sqrt(draw.uniform(1.1**2, 4, 600))]
    rows = [
        (i, float(r * np.cos(a)), float(r * np.sin(a)), int(i < 300)) for i, (r, a) in enumerate(zip(radius, angle))
    ]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    seeds = [r.key for r in oversample.margin_seeds(df, "label", "id", ["x", "y"]).collect()]
    assert 3 <= len(seeds) < 150
    assert min(radius[seeds]) > 0.6 and np.median(radius[seeds]) > 0.85


def test_svm_smote_reaches_parity(spark):
    draw = np.random.default_rng(5)
    rows = [(i, *map(float, draw.normal(size=2) + (i % 5 == 0)), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    assert oversample.svm_smote(df, "label", "id", ["x", "y"]).count() == 240 - 60


def test_csv_without_breaks_is_split(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("a,b\n" + "".join(f'{i},"x ""{i}"""\n' for i in range(20_000)) + "1,2,3,4\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        whole, split = (tables.read_csv(spark, path, "a int, b string", multi_line=m) for m in (True, False))
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
        assert split.filter("b = 'x \"7\"'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
