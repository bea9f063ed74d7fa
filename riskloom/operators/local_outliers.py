"""Local outlier factor of one column, exact and without comparing all pairs of values.

Equal values are one row with a count. Distinct values get their place in global order, and are cut
into chunks by place; each chunk also receives the 3k neighbouring distinct values on either side,
which is all that its factors depend on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import running_sums, weighted_quantile
from riskloom.operators.quantiles import clean_double

CHUNK = 50_000
#: Values times neighbours that one block may hold at a time
CELLS = 2_000_000
# Fixed value: keeps the density of coinciding points finite
TINY = 1e-10


def factors(x: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factor of each distinct value of a sorted block.

    A value's k neighbours lie among the k distinct values on either side. Members of the same value come first;
    among equally distant values the smaller one comes first.
    """
    at = np.arange(len(x))[:, None]
    near = at + np.arange(-k, k + 1)
    held = (near >= 0) & (near < len(x))
    near = np.clip(near, 0, len(x) - 1)
    far = np.where(held, np.abs(x[near] - x[at]), np.inf)
    members = np.where(held, n[near] - (near == at), 0)
    order = np.argsort(far, axis=1, kind="stable")
    near, far, members = (np.take_along_axis(m, order, axis=1) for m in (near, far, members))
    taken = np.clip(k - (np.cumsum(members, axis=1) - members), 0, members).astype(float)
    far = np.where(taken > 0, far, 0.0)
    reach = far.max(axis=1)
    reached = np.where(taken > 0, np.maximum(far, reach[near]), 0.0)
    density = 1.0 / ((taken * reached).sum(axis=1) / k + TINY)
    return (taken * density[near]).sum(axis=1) / k / density


def lof_by_value(df: DataFrame, column: str, k: int = 20, chunk: int = CHUNK) -> DataFrame:
    """(value, n, lof) per distinct value; empty when there are fewer than k + 1 values."""
    values = df.select(clean_double(F.col(column)).alias("value")).filter(F.col("value").isNotNull())
    counts = values.groupBy("value").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("one"))
    placed = running_sums(counts, "value", ["one", "n"]).filter(F.col("n_total") > k)
    halo = 3 * (k + 1)
    chunk = max(halo, min(chunk, CELLS // (2 * k + 1)))
    place = F.col("one_before")
    home = F.floor(place / chunk).cast("long")
    first, last = F.floor((place - halo) / chunk), F.floor((place + halo) / chunk)
    spread = placed.select(
        "value", "n", home.alias("home"),
        F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))).alias("chunk"),
    )

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        lof = factors(pdf.value.to_numpy(), pdf.n.to_numpy(), k)
        mine = (pdf.home == pdf.chunk).to_numpy()
        return pd.DataFrame({"value": pdf.value[mine], "n": pdf.n[mine], "lof": lof[mine]})

    return spread.groupBy("chunk").applyInPandas(score, "value double, n long, lof double")


def fit_column_lof(df: DataFrame, fitted) -> None:
    """Flag the share ``contamination`` of rows with the largest factors; the flag follows the value."""
    from riskloom.session import cut_lineage

    scored = cut_lineage(lof_by_value(df, fitted.column, fitted.rule.lof_neighbors))
    cut = weighted_quantile(scored, "lof", "n", 1 - fitted.rule.contamination)
    if cut is not None:
        fitted.flag_table = scored.filter(F.col("lof") > F.lit(cut)).select("value")
