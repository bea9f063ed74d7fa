"""Projections of new rows, resampling weights by inversion, and places in hash order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import components, resample
from riskloom.plans import explain


def table(spark, seed=0):
    rng = np.random.default_rng(seed)
    s = rng.laplace(size=(500, 2))
    x = np.c_[s @ [[2.0, 1.0], [0.5, -1.0]], s[:, 0] - s[:, 1]] + 5
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double"), x


def test_principal_projection_of_new_rows(spark):
    frame, x = table(spark)
    fitted = components.fit_principal_projection(frame, ["a", "b", "c"], 0.999)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    got = fitted.inverse_transform(fitted.transform(frame)).orderBy("id").toPandas()
    assert len(fitted.weights) == 2  # the third column follows from the others
    for i, at in enumerate(np.argsort(values)[::-1][:2]):
        assert np.abs(got[f"c{i + 1}"]) .to_numpy() == pytest.approx(np.abs(z @ vectors[:, at]), abs=1e-8)
    assert got[["a_back", "b_back", "c_back"]].to_numpy() == pytest.approx(x, abs=1e-8)
    gap = fitted.transform(spark.createDataFrame([(1, None, 1.0, 2.0)], frame.schema)).first()
    assert gap["c1"] is None
    with pytest.raises(ValueError):
        components.fit_principal_projection(frame.limit(0), ["a", "b", "c"])


def test_independent_projection_of_new_rows(spark):
    frame, x = table(spark)
    fitted = components.fit_independent_projection(frame, ["a", "b"], "id")
    got = fitted.inverse_transform(fitted.transform(frame)).orderBy("id").toPandas()
    assert got[["a_back", "b_back"]].to_numpy() == pytest.approx(x[:, :2], abs=1e-6)


def test_weights_are_poisson_and_stateless():
    cells = np.arange(400, dtype=np.uint64) * np.uint64(0x9E3779B9)
    for count in (1, 3, 50, 100_000):
        w = resample.poisson_weights(cells, np.full(400, count), 250, 7, 0)
        assert w.mean() == pytest.approx(count, rel=5 / np.sqrt(count * w.size)) and w.var() == pytest.approx(count, rel=0.05)
    one = resample.poisson_weights(cells[5:6], np.array([3]), 250, 7, 0)
    assert (one[0] == resample.poisson_weights(cells, np.full(400, 3), 250, 7, 0)[5]).all()
    assert not (one == resample.poisson_weights(cells[5:6], np.array([3]), 250, 7, 1)).all()
    assert not resample.poisson_weights(cells, np.zeros(400, int), 3, 7, 0).any()


def test_replicates_against_rows(spark):
    rng = np.random.default_rng(1)
    score, y = np.round(rng.random(3000), 3), rng.integers(0, 2, 3000)
    frame = spark.createDataFrame([(int(a), float(s)) for a, s in zip(y, score)], "y long, s double")
    got = {r["replicate"]: r for r in resample.bootstrap_replicates(frame, "y", "s", 10, 3).collect()}
    cells = resample._cells(frame, "y", "s", []).toPandas().sort_values("score")
    ids = cells["cell"].to_numpy(np.int64).view(np.uint64)
    pos, neg = (resample.poisson_weights(ids, cells[c].to_numpy(np.int64), 10, 3, i) for i, c in enumerate(("pos", "neg")))
    s = cells["score"].to_numpy()
    for b in range(10):
        p, n = pos[:, b], neg[:, b]
        below = np.cumsum(n) - n
        assert got[b]["auroc"] == pytest.approx((p * (below + n / 2)).sum() / (p.sum() * n.sum()))
        tp, fp = np.cumsum(p[::-1]), np.cumsum(n[::-1])
        assert got[b]["auprc"] == pytest.approx((p[::-1] * np.divide(tp, tp + fp, out=np.zeros(len(tp)), where=tp + fp > 0)).sum() / p.sum())
        assert got[b]["recall"] == pytest.approx(p[s >= 0.5].sum() / p.sum())
        assert got[b]["brier"] == pytest.approx((p * (1 - s) ** 2 + n * s**2).sum() / (p.sum() + n.sum()))


def test_rows_of_one_hash_keep_their_places(spark, monkeypatch):
    monkeypatch.setattr(explain, "hash_order", lambda key, seed: F.pmod(F.col(key), F.lit(7)).cast("bigint"))
    places = explain._ranked_by_hash(spark.range(50).withColumnRenamed("id", "k"), "k", "s").collect()
    assert sorted(r["place"] for r in places) == list(range(50)) and len({r["k"] for r in places}) == 50


def test_counterfactuals_differ_in_what_they_change(spark):
    from riskloom.plans.training import ModelSpec, fit_model
    from riskloom.session import cut_lineage

    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    y = (x.sum(axis=1) + 0.2 * rng.standard_normal(300) > 1.5).astype(float)
    frame = cut_lineage(spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double"))
    model = fit_model(frame, ModelSpec("logreg", ["a", "b", "c"]), "id")
    few = frame.filter("id < 20")
    found = explain.counterfactuals(few, model, ["a", "b", "c"], "id", target=0.1, k=3).toPandas()
    own = {r["id"]: r["score"] for r in explain.with_score(model.transform(few)).collect()}
    assert len(found) == 60 and (found.groupby("id")["changed"].nunique() == 3).all() and (found["changed"] != "").all()
    best = found[found["solution"] == 1].set_index("id")
    far = [i for i in own if abs(own[i] - 0.1) > 0.3]
    assert far and all(best.loc[i, "distance"] < 0.5 * abs(own[i] - 0.1) for i in far)
