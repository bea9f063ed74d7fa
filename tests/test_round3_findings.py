"""Cases of the third round of findings: plans that stay off the driver, and neighbour searches against brute force."""

import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from bindings import load
from riskloom.functions.hashing import HASH_SPACE, hash_order
from riskloom.operators import knn
from riskloom.plans import anomaly, explain

QUERIES = load()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tree_sums_send_no_side_of_the_join_through_the_driver(spark, sf_dir):
    # a packed file of a few MB may hold millions of rows, so its size must not decide for a broadcast
    for name in ("dtree", "xgb"):
        assert "BroadcastHashJoin" not in plan(QUERIES[f"x5_tree_sum_{name}"](spark, sf_dir))


def brute(q, p, k, skip_self):
    """Per query its k nearest (d2, key) of (key, x, y, ...) rows."""
    out = []
    for own, *x in q:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), key) for key, *y in p if not (skip_self and key == own))
        out += [(own, key, d2, i + 1) for i, (d2, key) in enumerate(near[:k])]
    return sorted(out)


def test_knn_join_with_many_small_boxes_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(knn, "BLOCK_POINTS", 16)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(knn, "LEAF_POINTS", 4)
    # clusters, copies of one point, a lone row far off and a box with fewer rows than neighbours asked for
    rows = [(i, float(rng.randrange(12)), float(rng.choice([0, 1, 500])), rng.random()) for i in range(300)]
    rows += [(i, 3.0, 1.0, 0.5) for i in range(300, 330)] + [(330, 1e6, -1e6, 0.0)]
    asked = rows[::3] + [(1000, 40.0, 250.0, 9.0), (1001, -1e7, 1e7, 0.0)]
    p, q = (spark.createDataFrame(r, "key long, a double, b double, c double") for r in (rows, asked))
    for k, skip_self in ((1, True), (5, False), (9, True)):
        near = knn.knn_join(q, p, "key", ["a", "b", "c"], k, skip_self).select("key", "neighbour", "d2", "position")
        assert sorted(map(tuple, near.collect())) == brute(asked, rows, k, skip_self)


def test_leaf_search_meets_few_points_and_keeps_ties():
    p = np.array([[x, y] for x in range(64) for y in range(64)], float)
    members = [np.array([2 * i, 2 * i + 1]) for i in range(len(p))]
    place, key, d2 = knn._search(p[:50], np.arange(0, 100, 2), np.full(50, np.inf), p, members, 4, True)
    found = [[] for _ in range(50)]
    for i, m, d in zip(place, key, d2):
        found[i].append((d, m))
    for i, got in enumerate(found):
        every = sorted((float(((p[i] - x) ** 2).sum()), m) for x, ms in zip(p, members) for m in ms if m != 2 * i)
        assert got == every[:4]


def test_boxes_in_reach_are_found_by_descent_without_a_table_of_all_boxes():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 2))
    nodes = [(0, 0.5, 1, 2), (1, 0.5, -1, -2), (1, 0.5, -3, -4)]
    box = 2 * (x[:, 0] >= 0.5) + (x[:, 1] >= 0.5)
    bounds = [Row(box=b, n=int((box == b).sum()), low=x[box == b].min(axis=0).tolist(), high=x[box == b].max(axis=0).tolist()) for b in range(4)]
    tree = knn._BoxTree(nodes, bounds, 2)
    asked, reach = rng.random((50, 2)) * 2 - 0.5, rng.random(50) / 10
    row, at = tree.within(asked, reach)
    low, high = np.array([b.low for b in bounds]), np.array([b.high for b in bounds])
    gaps = (np.maximum(np.maximum(low - asked[:, None], asked[:, None] - high), 0) ** 2).sum(axis=2)
    assert list(zip(row, at)) == list(zip(*np.nonzero(gaps <= reach[:, None])))


def test_counterfactuals_move_states_once_a_round_before_they_multiply(spark, sf_dir, monkeypatch):
    plans = []
    keep = explain.cut_lineage
    monkeypatch.setattr(explain, "cut_lineage", lambda df: plans.append(plan(df)) or keep(df))
    QUERIES["x8_counterfactuals"](spark, sf_dir)
    assert len(plans) == 2
    for text in plans:  # a plan lists its last step first
        assert text.count("Exchange hashpartitioning") == 1
        assert text.index("Generate explode") < text.index("Exchange hashpartitioning")


def test_isolation_trees_sample_the_rows_whose_hash_is_low(spark):
    df = spark.range(3000).withColumn("x", F.col("id") % 97)
    for share in (0.02, 1.0):
        cut = int(share * HASH_SPACE)
        wanted = {r.id for r in df.filter(hash_order("id", "42-tree-7") < F.lit(cut)).select("id").collect()}
        assert {r.id for r in df.filter(anomaly.hash_below(F.col("id"), "42-tree-7", cut)).select("id").collect()} == wanted
    assert "conv(" not in plan(df.filter(anomaly.hash_below(F.col("id"), "42-tree-7", 1 << 50)))


def test_repeated_rows_do_not_hide_the_neighbours_behind_them(spark):
    rows = [(i, float(i * i), 0.0) for i in range(20)] * 3
    df = spark.createDataFrame(rows, "key long, a double, b double")
    near = knn.knn_join(df, df, "key", ["a", "b"], 1, skip_self=True).select("key", "neighbour").distinct()
    assert sorted(map(tuple, near.collect())) == [(i, max(i - 1, 0) if i else 1) for i in range(20)]
