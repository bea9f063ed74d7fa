"""Bootstrap intervals, resampled differences, and the flat evaluation report."""

from __future__ import annotations

from bindings.base import query
from bindings.evaluation import predictions
from riskloom.operators import resample


@query("e10_bootstrap")
def e10_bootstrap(spark, sf_dir):
    return resample.bootstrap(predictions(spark, sf_dir), "mortality", "p_model", replicates=1000)


@query("e13_bootstrap_difference")
def e13_bootstrap_difference(spark, sf_dir):
    return resample.bootstrap_difference(predictions(spark, sf_dir), "mortality", "p_model", "p_points", 1000)


@query("e23_evaluation_report")
def e23_evaluation_report(spark, sf_dir):
    return resample.evaluation_report(predictions(spark, sf_dir), "mortality", "p_points", replicates=200)
