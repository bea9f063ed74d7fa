"""Tail probabilities on result rows (a handful per table), as Arrow-batched column functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import special


def _rowwise(function, *series: pd.Series) -> pd.Series:
    out = []
    for values in zip(*series):
        missing = any(v is None or math.isnan(v) for v in values)
        out.append(None if missing else function(*values))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return _rowwise(special.normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(special.chi2_upper, x, dof)


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(special.t_two_sided, t, dof)


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(special.f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(special.t_quantile, p, dof)
