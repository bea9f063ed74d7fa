"""Bootstrap intervals on (label, score) without re-scoring and without copying rows.

Equal rows are one cell with a count. In replicate b a cell with count c weighs Poisson(c), inverted
from a hash of cell, replicate and seed, so the same rows get the same weights in every step and on
any partitioning, and no generator keeps a state. Score ranges are worked on in parallel; what leaves a task is one short row per
range and replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.tails import normal_tail
from riskloom.operators.evaluate import ratio
from riskloom.operators.prefix import with_cut_range
from riskloom.session import cut_lineage, spread

_CHUNK = 1_024
_SALTS = 64
METRICS = ("auroc", "auprc", "accuracy", "precision", "recall", "f1", "brier")


def _uniform(cells: np.ndarray, replicates: int, seed: int, side: int) -> np.ndarray:
    """(cells, replicates) numbers in [0, 1): a function of cell, replicate, side and seed alone (splitmix64)."""
    turn = np.arange(replicates, dtype=np.uint64) * np.uint64(2) + np.uint64(side)
    x = cells[:, None] ^ _mixed(turn + np.uint64(seed % (1 << 32)) * np.uint64(0x100000001B3))[None, :]
    return (_mixed(x) >> np.uint64(11)).astype(float) / float(1 << 53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_table(count: int) -> tuple[int, np.ndarray]:
    """First value and cumulative probabilities of Poisson(count), without tails below 1e-20."""
    reach = 12 * np.sqrt(count) + 30
    low = max(0, int(count - reach))
    steps = np.log(count) - np.log(np.arange(low + 1, int(count + reach) + 1))
    logs = np.r_[0.0, np.cumsum(steps)]
    shares = np.exp(logs - logs.max())
    return low, np.cumsum(shares / shares.sum())


def poisson_weights(cells: np.ndarray, counts: np.ndarray, replicates: int, seed: int, side: int) -> np.ndarray:
    """(cells, replicates) Poisson(count) weights by inversion, one table per distinct count."""
    out = np.zeros((len(cells), replicates))
    for count in np.unique(counts[counts > 0]):
        at = np.flatnonzero(counts == count)
        low, table = _poisson_table(int(count))
        drawn = np.searchsorted(table, _uniform(cells[at], replicates, seed, side), "right")
        out[at] = low + np.minimum(drawn, len(table) - 1)
    return out


def _weights(pdf: pd.DataFrame, replicates: int, seed: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Chunks of cells in score order with their event and non-event weights per replicate."""
    pdf = pdf.sort_values(["score", "cell"], kind="stable")
    for start in range(0, len(pdf), _CHUNK):
        part = pdf.iloc[start : start + _CHUNK]
        cells = part.cell.to_numpy(np.int64).view(np.uint64)
        pos, neg = (poisson_weights(cells, part[c].to_numpy(np.int64), replicates, seed, i) for i, c in enumerate(("pos", "neg")))
        yield part, pos, neg


def _cells(df: DataFrame, label: str, score: str, extra: list[str]) -> DataFrame:
    """(cell, score, *extra, pos, neg): counts per distinct combination of scores."""
    fields = [F.col(score).cast("double").alias("score"), *[F.col(c).cast("double").alias(c) for c in extra]]
    rows = df.select(F.col(label).cast("long").alias("y"), *fields).dropna()
    grouped = rows.groupBy("score", *extra).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    return grouped.withColumn("cell", F.xxhash64("score", *extra))


def _range_totals(cells: DataFrame, replicates: int, seed: int, threshold: float) -> DataFrame:
    """Per (range, replicate): events, non-events, wins inside the range, counts at the threshold, error.

    A range with a single score value may be split over tasks: its wins follow from its totals.
    """
    names = ["pos", "neg", "wins", "tp", "fp", "err"]

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {c: np.zeros(replicates) for c in names}
        below = np.zeros(replicates)
        pending_score, pending = None, None
        for part, pos, neg in _weights(pdf, replicates, seed):
            s = part.score.to_numpy()[:, None]
            sums["pos"] += pos.sum(axis=0)
            sums["neg"] += neg.sum(axis=0)
            sums["tp"] += (pos * (s >= threshold)).sum(axis=0)
            sums["fp"] += (neg * (s >= threshold)).sum(axis=0)
            sums["err"] += (pos * (1 - s) ** 2 + neg * s**2).sum(axis=0)
            flat = part.score.to_numpy()
            starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            gp, gn = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
            if pending is not None and pending_score == flat[0]:  # a score that goes on from the last chunk
                gp[0], gn[0] = gp[0] + pending[0], gn[0] + pending[1]
            elif pending is not None:
                gp, gn = np.vstack([pending[0], gp]), np.vstack([pending[1], gn])
            # all scores but the last are complete: prefix sums of the replicate vectors
            before = below + np.cumsum(gn, axis=0) - gn
            sums["wins"] += (gp[:-1] * (before[:-1] + gn[:-1] / 2)).sum(axis=0)
            below, pending_score, pending = before[-1], flat[-1], (gp[-1], gn[-1])
        if pending is not None:
            sums["wins"] += pending[0] * (below + pending[1] / 2)
        return pd.DataFrame(
            {"range": int(pdf["range"].iloc[0]), "replicate": np.arange(replicates), **sums}
        )

    single = F.col("range") % 2 == 0
    salted = cells.withColumn("salt", F.when(single, F.pmod("cell", F.lit(_SALTS))).otherwise(F.lit(0)))
    schema = "range int, replicate int, " + ", ".join(f"{c} double" for c in names)
    parts = spread(salted, "range", "salt").groupBy("range", "salt").applyInPandas(totals, schema)
    summed = parts.groupBy("range", "replicate").agg(*[F.sum(c).alias(c) for c in names])
    return summed.withColumn(
        "wins", F.when(single, F.col("pos") * F.col("neg") / 2).otherwise(F.col("wins"))
    )


def _replicate_areas(totals: DataFrame) -> DataFrame:
    """Per replicate: class totals, counts at the threshold, error and AUROC from range totals."""
    lower = Window.partitionBy("replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("below", F.coalesce(F.sum("neg").over(lower), F.lit(0.0)))
    return placed.groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp", "err")],
        F.try_divide(
            F.sum(F.col("wins") + F.col("pos") * F.col("below")), F.sum("pos") * F.sum("neg")
        ).alias("auroc"),
    )


def _precision_sums(cells: DataFrame, totals: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per replicate the sum of event weight times precision, ranges joined to what lies above them."""
    higher = (
        Window.partitionBy("replicate").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    )
    above = totals.select(
        "range", "replicate",
        F.coalesce(F.sum("pos").over(higher), F.lit(0.0)).alias("pos_above"),
        F.coalesce(F.sum("neg").over(higher), F.lit(0.0)).alias("neg_above"),
    )

    def precision(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("replicate")
        tp, fp = right.pos_above.to_numpy().copy(), right.neg_above.to_numpy().copy()
        total = np.zeros(replicates)
        chunks = list(range(0, len(left), _CHUNK))
        left = left.sort_values("score", ascending=False)
        for start in chunks:
            part = left.iloc[start : start + _CHUNK]
            for block, pos, neg in _weights(part, replicates, seed):
                hits, false = tp + np.cumsum(pos[::-1], axis=0), fp + np.cumsum(neg[::-1], axis=0)
                called = hits + false
                total += (pos[::-1] * np.divide(hits, called, out=np.zeros_like(called), where=called > 0)).sum(axis=0)
                tp, fp = hits[-1], false[-1]
        return pd.DataFrame({"replicate": np.arange(replicates), "precision_sum": total})

    left, right = spread(cells, "range"), spread(above, "range")
    parts = left.groupBy("range").cogroup(right.groupBy("range")).applyInPandas(
        precision, "replicate int, precision_sum double"
    )
    return parts.groupBy("replicate").agg(F.sum("precision_sum").alias("precision_sum"))


def bootstrap_replicates(
    df: DataFrame, label: str, score: str, replicates: int = 1000, seed: int = 42, threshold: float = 0.5
) -> DataFrame:
    """One row per replicate with seven metrics; AUROC and average precision null when a class is empty."""
    cells = cut_lineage(
        with_cut_range(_cells(df, label, score, []), "score").withColumnRenamed("_range", "range")
    )
    totals = cut_lineage(_range_totals(cells, replicates, seed, threshold))
    areas = _replicate_areas(totals).join(_precision_sums(cells, totals, replicates, seed), "replicate")
    tp, fp, p, q = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    return areas.select(
        "replicate",
        "auroc",
        F.try_divide(F.col("precision_sum"), p).alias("auprc"),
        ratio(tp + q - fp, p + q).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, p).alias("recall"),
        ratio(2 * tp, tp + fp + p).alias("f1"),
        ratio(F.col("err"), p + q).alias("brier"),
    )


def summarise_replicates(replicates: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(metric, n, mean, std, ci_low, ci_high) over the replicates; the table has one row per replicate."""
    tail = (1 - confidence) / 2
    long = replicates.unpivot(["replicate"], list(METRICS), "metric", "v").filter(F.col("v").isNotNull())
    return long.groupBy("metric").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.percentile("v", F.lit(tail)).alias("ci_low"),
        F.percentile("v", F.lit(1 - tail)).alias("ci_high"),
    )


def bootstrap(
    df: DataFrame, label: str, score: str, replicates: int = 1000, seed: int = 42,
    threshold: float = 0.5, confidence: float = 0.95,
) -> DataFrame:
    drawn = bootstrap_replicates(df, label, score, replicates, seed, threshold)
    return summarise_replicates(drawn, confidence)


def bootstrap_difference(
    df: DataFrame, label: str, first: str, second: str, replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """AUROC difference of two scores on the same resamples: difference, standard error, z and p."""
    narrow = df.select(label, F.col(first).alias("s1"), F.col(second).alias("s2")).dropna()
    cells = cut_lineage(_cells(narrow, label, "s1", ["s2"]))
    areas = []
    for i, column in enumerate(("score", "s2"), start=1):
        ranged = with_cut_range(cells.select("cell", "pos", "neg", F.col(column).alias("score")), "score")
        totals = _range_totals(ranged.withColumnRenamed("_range", "range"), replicates, seed, 0.5)
        areas.append(_replicate_areas(cut_lineage(totals)).select("replicate", F.col("auroc").alias(f"auc_{i}")))
    gaps = areas[0].join(areas[1], "replicate").withColumn("gap", F.col("auc_1") - F.col("auc_2"))
    summary = gaps.agg(F.count("gap").alias("n"), F.stddev_samp("gap").alias("se"))
    from riskloom.operators.evaluate import auroc

    both = narrow.unpivot([label], ["s1", "s2"], "model", "score")
    point = auroc(both, label, "score", ["model"])
    values = point.agg(
        F.max(F.when(F.col("model") == "s1", F.col("auroc"))).alias("auc_1"),
        F.max(F.when(F.col("model") == "s2", F.col("auroc"))).alias("auc_2"),
    ).withColumn("_one", F.lit(1))
    row = values.join(summary.withColumn("_one", F.lit(1)), "_one").drop("_one")
    difference = F.col("auc_1") - F.col("auc_2")
    z = F.coalesce(F.try_divide(difference, F.col("se")), F.lit(0.0))
    return row.select(
        "n", "auc_1", "auc_2", difference.alias("difference"), "se", z.alias("z"), normal_tail(z).alias("p_value")
    )


def evaluation_report(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, replicates: int = 1000,
    train_rows: int | None = None,
) -> DataFrame:
    """One wide row: metrics with bootstrap and jackknife columns. Refuses a test set as long as the
    training set, the sign of evaluating on training rows."""
    from riskloom.operators.compare import jackknife
    from riskloom.operators.evaluate import rank_measures, ranked_scores, threshold_metrics

    base = threshold_metrics(df, label, score, threshold)
    if train_rows is not None:
        counts = base.first()
        if counts.tp + counts.fp + counts.fn + counts.tn == train_rows:
            raise ValueError("test and training tables have the same number of rows")
    drawn = bootstrap(df, label, score, replicates, threshold=threshold)
    left_out = jackknife(df, label, score, threshold)

    def flat(table: DataFrame, prefix: str, fields: tuple[str, ...]) -> DataFrame:
        return table.agg(
            *[
                F.max(F.when(F.col("metric") == m, F.col(f))).alias(f"{prefix}_{m}_{f}")
                for m in METRICS
                for f in fields
            ]
        )

    parts = [
        base,
        rank_measures(ranked_scores(df, label, score)),
        flat(drawn, "bootstrap", ("mean", "std", "ci_low", "ci_high")),
        flat(left_out, "jackknife", ("mean", "std_error", "ci_low", "ci_high")),
    ]
    row = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        row = row.join(part.withColumn("_one", F.lit(1)), "_one")
    return row.drop("_one")
