"""Comparing two scores on the same rows, leave-one-out intervals, and tests on score lists."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.special import normal_quantile
from riskloom.functions.tails import normal_tail, t_quantile, t_tail
from riskloom.operators.evaluate import (
    rank_measures,
    ranked_scores,
    ratio,
    score_histogram,
    threshold_metrics,
)
from riskloom.operators.prefix import running_sums, sums_over_ranges, with_range
from riskloom.session import cut_lineage

Z95 = 1.96


def _complete(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    return df.select(
        F.col(label).cast("int").alias("y"),
        F.col(first).cast("double").alias("s1"),
        F.col(second).cast("double").alias("s2"),
    ).dropna()


def _placements(counts: DataFrame, score: str, name: str) -> DataFrame:
    """Per distinct score: share of the other class it beats, for an event and for a non-event."""
    hist = counts.groupBy(score).agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(F.lit(0))).alias("neg"),
    )
    ranked = running_sums(hist, score, ["pos", "neg"])
    event = (F.col("neg_before") + F.col("neg") / 2) / F.col("neg_total")
    other = (F.col("pos_before") + F.col("pos") / 2) / F.col("pos_total")
    # events: share of non-events below; non-events: share of events below (1 - placement)
    return ranked.select(score, event.alias(f"e_{name}"), other.alias(f"n_{name}"))


def delong(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """Areas of two correlated curves, variance of their difference, z and p (0 and 1 without spread)."""
    counts = _complete(df, label, first, second).groupBy("y", "s1", "s2").agg(F.count("*").alias("w"))
    counts = cut_lineage(counts)
    placed = counts.join(_placements(counts, "s1", "1"), "s1").join(_placements(counts, "s2", "2"), "s2")
    is_event = F.col("y") == 1
    rows = placed.select(
        "y", "w",
        F.when(is_event, F.col("e_1")).otherwise(F.col("n_1")).alias("v1"),
        F.when(is_event, F.col("e_2")).otherwise(F.col("n_2")).alias("v2"),
    )
    w, v1, v2 = F.col("w"), F.col("v1"), F.col("v2")
    per_class = rows.groupBy("y").agg(
        F.sum(w).alias("n"),
        (F.sum(w * v1) / F.sum(w)).alias("m1"),
        (F.sum(w * (v1 - v2)) / F.sum(w)).alias("m"),
        F.sum(w * (v1 - v2) * (v1 - v2)).alias("q"),
    )
    # variance of the difference of placements = var1 + var2 - 2 cov, per class
    spread = (F.col("q") - F.col("n") * F.col("m") * F.col("m")) / (F.col("n") - 1) / F.col("n")
    summary = per_class.agg(
        F.max(F.when(F.col("y") == 1, F.col("n"))).alias("n_pos"),
        F.max(F.when(F.col("y") == 0, F.col("n"))).alias("n_neg"),
        F.max(F.when(F.col("y") == 1, F.col("m1"))).alias("auc_1"),
        F.max(F.when(F.col("y") == 1, F.col("m1") - F.col("m"))).alias("auc_2"),
        F.sum(spread).alias("variance"),
    )
    difference = F.col("auc_1") - F.col("auc_2")
    usable = F.col("variance") > 0
    return summary.select(
        "n_pos", "n_neg", "auc_1", "auc_2", difference.alias("difference"), "variance",
        F.when(usable, difference / F.sqrt("variance")).otherwise(F.lit(0.0)).alias("z"),
    ).withColumn("p_value", normal_tail("z"))


def category_index(score: Column, bounds: Sequence[float]) -> Column:
    """How many bounds are <= score."""
    return reduce(lambda a, b: a + b, [(score >= F.lit(x)).cast("int") for x in bounds])


def net_reclassification(
    df: DataFrame, label: str, new: str, old: str, bounds: Sequence[float] | None = None
) -> DataFrame:
    """Net share of events moving up and of non-events moving down; by category when bounds are given.

    The standard error is ``sqrt(e^2 / n_events + n^2 / n_nonevents)`` of the two net shares.
    """
    rows = _complete(df, label, new, old)
    a, b = F.col("s1"), F.col("s2")
    if bounds is not None:
        a, b = category_index(a, bounds), category_index(b, bounds)
    event = F.col("y") == 1
    counts = rows.agg(
        F.count_if(event).alias("n_events"),
        F.count_if(~event).alias("n_nonevents"),
        (F.count_if(event & (a > b)) - F.count_if(event & (a < b))).alias("net_e"),
        (F.count_if(~event & (a < b)) - F.count_if(~event & (a > b))).alias("net_n"),
    )
    e = F.col("net_e") / F.col("n_events")
    n = F.col("net_n") / F.col("n_nonevents")
    se = F.sqrt(e * e / F.col("n_events") + n * n / F.col("n_nonevents"))
    return counts.select(
        "n_events", "n_nonevents", (e + n).alias("nri"), e.alias("nri_events"), n.alias("nri_nonevents"),
        se.alias("se"), F.when(se > 0, (e + n) / se).otherwise(F.lit(0.0)).alias("z"),
    ).withColumn("p_value", normal_tail("z"))


def discrimination_improvement(df: DataFrame, label: str, new: str, old: str) -> DataFrame:
    """Difference of the two mean-score separations, with a normal test."""
    rows = _complete(df, label, new, old)
    event, other = F.col("y") == 1, F.col("y") == 0
    mean = lambda c, s: F.avg(F.when(c, F.col(s)))
    var = lambda c, s: F.var_pop(F.when(c, F.col(s)))
    sums = rows.agg(
        (mean(event, "s1") - mean(other, "s1")).alias("separation_new"),
        (mean(event, "s2") - mean(other, "s2")).alias("separation_old"),
        (
            (var(event, "s1") + var(event, "s2")) / F.count_if(event)
            + (var(other, "s1") + var(other, "s2")) / F.count_if(other)
        ).alias("v"),
    )
    idi, se = F.col("separation_new") - F.col("separation_old"), F.sqrt("v")
    return sums.select(
        "separation_new", "separation_old", idi.alias("idi"), se.alias("se"),
        F.when(se > 0, idi / se).otherwise(F.lit(0.0)).alias("z"),
    ).withColumn("p_value", normal_tail("z"))


def superiority(p: Column, difference: Column) -> Column:
    """Level by p-value first, then by sign."""
    return (
        F.when(p < 0.001, "highly_significant").when(p < 0.01, "significant").when(p < 0.05, "marginal")
        .when(difference > 0, "favorable_trend").when(difference < 0, "inferior").otherwise("equivalent")
    )


def comparison_report(
    df: DataFrame, label: str, model: str, score: str, threshold: float = 0.5
) -> DataFrame:
    """One row: areas with interval, reclassification, discrimination, Brier, accuracy, rates, level."""
    areas = delong(df, label, model, score).select(
        F.col("auc_1").alias("model_auc"), F.col("auc_2").alias("score_auc"),
        F.col("difference").alias("auc_difference"), F.col("z").alias("auc_z"),
        F.col("p_value").alias("auc_p"),
    )
    nri = net_reclassification(df, label, model, score).select(
        "nri", "nri_events", "nri_nonevents", F.col("p_value").alias("nri_p")
    )
    idi = discrimination_improvement(df, label, model, score).select(
        "idi", F.col("p_value").alias("idi_p")
    )
    rows = _complete(df, label, model, score)
    event = F.col("y") == 1
    parts = []
    for s, name in (("s1", "model"), ("s2", "score")):
        hit = F.col(s) >= threshold
        tp, tn = F.count_if(event & hit), F.count_if(~event & ~hit)
        parts += [
            F.avg(F.pow(F.col(s) - F.col("y"), 2)).alias(f"{name}_brier"),
            ratio(tp + tn, F.count("*")).alias(f"{name}_accuracy"),
            ratio(tp, F.count_if(event)).alias(f"{name}_sensitivity"),
            ratio(tn, F.count_if(~event)).alias(f"{name}_specificity"),
        ]
    rates = rows.agg(*parts)
    one = [t.withColumn("_one", F.lit(1)) for t in (areas, nri, idi, rates)]
    joined = reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")
    se = F.when(F.col("auc_z") != 0, F.abs(F.col("auc_difference") / F.col("auc_z"))).otherwise(F.lit(0.0))
    return joined.withColumns(
        {
            "auc_ci_low": F.col("auc_difference") - Z95 * se,
            "auc_ci_high": F.col("auc_difference") + Z95 * se,
            "brier_difference": F.col("model_brier") - F.col("score_brier"),
            "superiority": superiority(F.col("auc_p"), F.col("auc_difference")),
            "direction": F.signum("auc_difference").cast("int"),
        }
    )


def jackknife(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, confidence: float = 0.95
) -> DataFrame:
    """Leave-one-out mean, standard error and intervals of seven metrics, without re-scoring rows.

    Every left-out value follows from counts below and above the row's score, so all rows with the
    same label and score share one value. ``ci_low``/``ci_high`` divide the standard error by sqrt(n)
    once more (kept for comparability); ``ci_standard_*`` do not.
    """
    counts = threshold_metrics(df, label, score, threshold).first()  # one small row
    whole = {c: counts[c] for c in ("tp", "fp", "fn", "tn")}
    rows_total = sum(whole.values())
    error_total = counts.brier * rows_total
    hist = with_range(cut_lineage(score_histogram(df, label, score)), "score", ["pos", "neg"])
    ranked = cut_lineage(sums_over_ranges(hist, "score", ["pos", "neg"]))  # one row per score
    pos, neg = F.col("pos"), F.col("neg")
    tp = (F.col("pos_total") - F.col("pos_before")).cast("double")
    called = tp + F.col("neg_total") - F.col("neg_before")
    zero = F.lit(0.0)
    levels = ranked.withColumns(
        {
            "a": pos * tp / called,
            "b": F.coalesce(F.try_divide(pos * (tp - 1), called - 1), zero),
            "c": F.coalesce(F.try_divide(pos * tp, called - 1), zero),
            "wins": pos * (F.col("neg_before") + neg / 2.0),
        }
    )
    s = sums_over_ranges(levels, "score", ["a", "b", "c", "wins"])
    p, q = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    n = p + q
    above = F.col("a_total") - F.col("a_before") - F.col("a")
    own = F.coalesce(F.try_divide((pos - 1) * (tp - 1), called - 1), zero)
    hit = (F.col("score") >= threshold).cast("int")
    auroc = {
        1: F.try_divide(F.col("wins_total") - F.col("neg_before") - neg / 2.0, (p - 1) * q),
        0: F.try_divide(F.col("wins_total") - (p - F.col("pos_before") - pos / 2.0), p * (q - 1)),
    }
    auprc = {
        1: F.try_divide(above + own + F.col("b_before"), p - 1),
        0: F.try_divide(above + F.col("c") + F.col("c_before"), p),
    }

    def left_out(y: int) -> dict[str, Column]:
        """The seven metrics after taking out one row of this level with label ``y``."""
        left = {
            name: F.lit(whole[name]) - (hit == h).cast("int") * int(y == label_of)
            for name, label_of, h in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
        }
        error = (F.col("score") - y) * (F.col("score") - y)
        return {
            "auroc": auroc[y],
            "auprc": auprc[y],
            "accuracy": ratio(left["tp"] + left["tn"], n - 1),
            "precision": ratio(left["tp"], left["tp"] + left["fp"]),
            "recall": ratio(left["tp"], left["tp"] + left["fn"]),
            "f1": ratio(2 * left["tp"], 2 * left["tp"] + left["fp"] + left["fn"]),
            "brier": (F.lit(error_total) - error) / (n - 1),
        }

    # shift by the value on all rows: left-out values differ only slightly, so no digits are lost
    full = {m: F.lit(counts[m]) for m in ("accuracy", "precision", "recall", "f1", "brier")}
    full["auroc"] = F.try_divide(F.col("wins_total"), p * q)
    full["auprc"] = F.try_divide(F.col("a_total"), p)
    event, other = left_out(1), left_out(0)

    # one row per level, label and metric: four sums each instead of dozens in one aggregate
    entries = [
        F.struct(
            F.lit(m).alias("metric"), weight.cast("double").alias("w"),
            F.when(weight > 0, values[m] - full[m]).otherwise(zero).alias("gap"), full[m].alias("full"),
        )
        for weight, values in ((pos, event), (neg, other))
        for m in values
    ]
    w, gap = F.col("w"), F.col("gap")
    long = (
        s.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .groupBy("metric")
        .agg(
            F.sum(w).alias("n"), F.max("full").alias("anchor"), F.sum(w * gap).alias("d1"),
            F.sum(w * gap * gap).alias("d2"),
        )
    )
    rows, d = F.col("n"), F.col("d1") / F.col("n")
    se = F.sqrt((rows - 1) / rows * F.greatest(F.col("d2") - rows * d * d, zero))
    reach = t_quantile(F.lit((1 + confidence) / 2), rows - 1)
    out = long.select(
        "metric", rows.cast("long").alias("n"), (F.col("anchor") + d).alias("mean"), se.alias("std_error"),
        reach.alias("t"),
    )
    half, standard = F.col("t") * F.col("std_error") / F.sqrt("n"), F.col("t") * F.col("std_error")
    return out.select(
        "metric", "n", "mean", "std_error",
        (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
        (F.col("mean") - standard).alias("ci_standard_low"),
        (F.col("mean") + standard).alias("ci_standard_high"),
    )


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value by Royston's 1995 approximation, 3 to 5,000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return 1.0, (0.0 if n < 3 else 1.0)
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    u = 1 / math.sqrt(n)
    c = m / math.sqrt(ssq)
    a = np.zeros(n)
    if n == 3:
        a[0], a[2] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        # Royston's polynomial coefficients
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n <= 5:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        else:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w >= 1.0:
        return w, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(max(g - math.log(1 - w), 1e-300))
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, k = math.log(1 - w), math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def effect_band(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    )


def pairwise_model_tests(
    scores: DataFrame, model: str = "model", run: str = "run", value: str = "value", alpha: float = 0.05
) -> DataFrame:
    """All model pairs on their score lists: paired t if both lists look normal, else Mann-Whitney.

    ``scores`` is a results table, one row per model and run (at most a few hundred runs a model).
    """
    narrow = scores.select(F.col(model).alias("model"), F.col(run).alias("run"), F.col(value).alias("v"))

    def normality(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pdf.model.iloc[0]], "p": [shapiro_wilk(pdf.v.to_numpy())[1]]})

    # groups hold one model's runs, not data rows
    normal = narrow.groupBy("model").applyInPandas(normality, "model string, p double")
    moments = narrow.groupBy("model").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("var")
    ).join(normal, "model")
    side = lambda t, i: t.select(*[F.col(c).alias(f"{c}_{i}") for c in t.columns])
    pairs = side(moments, 1).join(side(moments, 2), F.col("model_1") < F.col("model_2"))
    aligned = side(narrow, 1).join(
        side(narrow, 2), (F.col("run_1") == F.col("run_2")) & (F.col("model_1") < F.col("model_2"))
    )
    gap = F.col("v_1") - F.col("v_2")
    paired = aligned.groupBy("model_1", "model_2").agg(
        F.count("*").alias("n_paired"), F.avg(gap).alias("gap"), F.stddev_samp(gap).alias("gap_sd")
    )
    first = side(narrow.drop("run"), 1)
    second = side(narrow.drop("run"), 2)
    stacked = pairs.select("model_1", "model_2").join(first, "model_1").select(
        "model_1", "model_2", F.lit(1).alias("g"), F.col("v_1").alias("v")
    ).unionByName(
        pairs.select("model_1", "model_2").join(second, "model_2").select(
            "model_1", "model_2", F.lit(0).alias("g"), F.col("v_2").alias("v")
        )
    )
    from riskloom.operators.association import mann_whitney

    u = mann_whitney(stacked, "v", "g", ["model_1", "model_2"]).select(
        "model_1", "model_2", "u", F.col("p_value").alias("u_p")
    )
    both = pairs.join(paired, ["model_1", "model_2"], "left").join(u, ["model_1", "model_2"], "left")
    t = F.try_divide(F.col("gap"), F.col("gap_sd") / F.sqrt("n_paired"))
    gaussian = (F.col("p_1") > alpha) & (F.col("p_2") > alpha)
    pooled = F.sqrt(
        ((F.col("n_1") - 1) * F.col("var_1") + (F.col("n_2") - 1) * F.col("var_2"))
        / (F.col("n_1") + F.col("n_2") - 2)
    )
    d = F.coalesce(F.try_divide(F.col("m_1") - F.col("m_2"), pooled), F.lit(0.0))
    return both.select(
        "model_1", "model_2", F.col("m_1").alias("mean_1"), F.col("m_2").alias("mean_2"),
        F.col("p_1").alias("normal_p_1"), F.col("p_2").alias("normal_p_2"),
        F.when(gaussian, "paired_t").otherwise("mann_whitney").alias("test"),
        F.when(gaussian, t).otherwise(F.col("u")).alias("statistic"),
        F.when(gaussian, t_tail(t, (F.col("n_paired") - 1).cast("double"))).otherwise(F.col("u_p")).alias("p_value"),
        d.alias("effect_size"), effect_band(d).alias("effect"),
    ).withColumn("significant", F.col("p_value") < alpha)


def rank_models(
    metrics: DataFrame, primary: str = "auroc", secondary: Sequence[str] = ("auprc", "f1", "recall"),
    thresholds: dict[str, float] | None = None, max_penalty: float = 0.0,
) -> DataFrame:
    """Weighted score (0.7 primary, 0.3 shared), thresholds, complexity penalty and rank per model.

    ``metrics`` is long: (model, metric, value), with the optional metric ``complexity``.
    """
    weights = {primary: 0.7, **{m: 0.3 / len(secondary) for m in secondary}}
    entries = [F.lit(x) for pair in weights.items() for x in pair]
    weight = F.element_at(F.create_map(*entries), F.col("metric"))
    value = F.coalesce(F.nanvl(F.col("value"), F.lit(0.0)), F.lit(0.0))
    failed = F.lit(0)
    for m, low in (thresholds or {}).items():
        reached = F.count_if((F.col("metric") == m) & ~F.isnan("value") & (F.col("value") >= low))
        failed = failed + (reached == 0).cast("int")
    per_model = metrics.groupBy("model").agg(
        F.coalesce(F.try_divide(F.sum(weight * value), F.sum(weight)), F.lit(0.0)).alias("weighted_score"),
        F.coalesce(F.max(F.when(F.col("metric") == primary, F.col("value"))), F.lit(0.0)).alias("primary_score"),
        F.max(F.when(F.col("metric") == "complexity", F.col("value"))).alias("complexity"),
        (failed == 0).alias("meets_thresholds"),
    )
    everyone = Window.partitionBy(F.lit(0))
    share = F.coalesce(F.col("complexity") / F.max("complexity").over(everyone), F.lit(0.0))
    scored = per_model.withColumn("weighted_score", F.col("weighted_score") * (1 - share * max_penalty))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("meets_thresholds"), F.desc("weighted_score"), "model")
    return scored.withColumn("rank", F.row_number().over(order)).drop("complexity")


def model_metrics(df: DataFrame, label: str, score: str, model: str, threshold: float = 0.5) -> DataFrame:
    """Long (model, metric, value) for all models' predictions, in one pass per measure family."""
    rates = threshold_metrics(df, label, score, threshold, [model])
    ranks = rank_measures(ranked_scores(df, label, score, [model]), [model])
    names = ["auroc", "auprc", "accuracy", "precision", "recall", "f1", "specificity", "npv", "brier"]
    return rates.join(ranks, model).unpivot([model], names, "metric", "value").withColumnRenamed(model, "model")


def metric_differences(metrics: DataFrame) -> DataFrame:
    """Difference of each metric for every pair of models."""
    a = metrics.select(F.col("model").alias("model_1"), "metric", F.col("value").alias("value_1"))
    b = metrics.select(F.col("model").alias("model_2"), "metric", F.col("value").alias("value_2"))
    return (
        a.join(b, "metric")
        .filter(F.col("model_1") < F.col("model_2"))
        .withColumn("difference", F.col("value_1") - F.col("value_2"))
    )
