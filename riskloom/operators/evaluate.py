"""Evaluation of predictions: a table of (label 0/1, score), one or many models.

Every rank statistic starts from the score histogram (one row per distinct score), so ties and hot
scores cost one row, and uses range-wise running sums instead of a global sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.prefix import running_sums
from riskloom.operators.quantiles import quantiles
from riskloom.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(label: str, score: str, threshold: float) -> dict[str, Column]:
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    return {
        "tp": F.count_if(y & hit),
        "fp": F.count_if(~y & hit),
        "fn": F.count_if(y & ~hit),
        "tn": F.count_if(~y & ~hit),
    }


def confusion_rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio(tn, tn + fp),
        "npv": ratio(tn, tn + fn),
    }


def threshold_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Counts, rates and Brier score at a threshold, in one aggregation."""
    error = F.col(score) - F.col(label)
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by)
        .agg(
            *[c.alias(n) for n, c in confusion_counts(label, score, threshold).items()],
            F.avg(error * error).alias("brier"),
        )
        .withColumns(confusion_rates())
    )


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    predicted = (F.col(score) >= threshold).cast("int")
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(label).cast("int").alias("actual"), predicted.alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def score_histogram(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, distinct score): number of events and non-events."""
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.col(label).cast("long")).alias("pos"),
            F.sum(1 - F.col(label).cast("long")).alias("neg"),
        )
    )


def ranked_scores(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Score histogram with events / non-events below each score and in total.

    The histogram is written once: ranges, offsets and sums read it instead of the rows.
    """
    hist = cut_lineage(score_histogram(df, label, score, by))
    return running_sums(hist, "score", ["pos", "neg"], by)


def rank_measures(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties half) and average precision from ranked scores, null when a class is missing."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    captured = F.col("pos_total") - F.col("pos_before")
    called = captured + F.col("neg_total") - F.col("neg_before")
    totals = F.max("pos_total").cast("double"), F.max("neg_total").cast("double")
    return ranked.groupBy(*by).agg(
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
        F.try_divide(
            F.sum(pos * (F.col("neg_before") + neg / 2)), totals[0] * totals[1]
        ).alias("auroc"),
        F.try_divide(F.sum(pos * captured / called), totals[0]).alias("auprc"),
    )


def auroc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return rank_measures(ranked_scores(df, label, score, by), by).drop("auprc")


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return rank_measures(ranked_scores(df, label, score, by), by).drop("auroc")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Squared and absolute errors, r2, explained variance and the exact median absolute error."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    both = df.filter(y.isNotNull() & p.isNotNull())
    error = y - p
    median = quantiles(both, {"abs_error": F.abs(error)}, [0.5])["abs_error"][0]
    return both.agg(
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(y))).alias("r2"),
        (1 - F.try_divide(F.var_pop(error), F.var_pop(y))).alias("explained_variance"),
    ).withColumn("median_abs_error", F.lit(median).cast("double"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with a support-weighted row ``weighted``."""
    cells = (
        df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(label).cast("string").alias("a"), F.col(predicted).cast("string").alias("p"))
        .agg(F.count("*").alias("n"))
    )
    # each cell counts once for its actual class and once for its predicted class
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("a").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("called"),
                    F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
                ),
                F.struct(
                    F.col("p").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("called"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    ).select(
        "class",
        "support",
        ratio(F.col("hit"), F.col("called")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"),
    )
    weighted = per_class.agg(
        F.lit("weighted").alias("class"),
        F.sum("support").alias("support"),
        *[
            ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
            for c in ("precision", "recall", "f1")
        ],
    )
    return per_class.unionByName(weighted)


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """True and false positive rate at each distinct score used as threshold."""
    ranked = ranked_scores(df, label, score, by)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return ranked.select(
        *by,
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        "pos_total",
        "neg_total",
        ratio(tp, F.col("pos_total")).alias("tpr"),
        ratio(fp, F.col("neg_total")).alias("fpr"),
    )


def youden_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest such threshold wins a tie.

    Ties are compared on whole numbers (tp * N - fp * P), not on rounded rates.
    """
    wide = "decimal(38,0)"
    gain = F.col("tp").cast("decimal(19,0)") * F.col("neg_total").cast("decimal(19,0)") - F.col(
        "fp"
    ).cast("decimal(19,0)") * F.col("pos_total").cast("decimal(19,0)")
    best = roc_points(df, label, score, by).groupBy(*by).agg(
        F.max(F.struct(gain.cast(wide).alias("gain"), "threshold", "tpr", "fpr")).alias("best")
    )
    return best.select(
        *by, "best.threshold", "best.tpr", "best.fpr",
        (F.col("best.tpr") - F.col("best.fpr")).alias("youden"),
    )


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin; the lowest edge belongs to the first bin."""
    inner = edges[1:-1]
    if not inner:
        return F.lit(0)
    return sum((F.when(value > e, 1).otherwise(F.lit(0)) for e in inner), F.lit(0))


def calibration_curve(
    df: DataFrame, label: str, score: str, n_bins: int = 10, strategy: str = "quantile"
) -> DataFrame:
    """Mean score and event rate of each non-empty bin; bins are right-closed."""
    kept = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    steps = [i / n_bins for i in range(n_bins + 1)]
    if strategy == "quantile":
        edges = sorted(set(x for x in quantiles(kept, [score], steps)[score] if x is not None))
    elif strategy == "uniform":
        edges = steps
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return (
        kept.groupBy(edge_bin(F.col(score), edges).alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg(score).alias("mean_score"),
            F.avg(F.col(label).cast("double")).alias("event_rate"),
        )
    )


def decision_curve(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none, per threshold.

    Rows are first counted by how many thresholds they reach (at most one more group than there are
    thresholds), then summed from the top: no row is paired with every threshold.
    """
    grid = sorted(thresholds or [(2 * i + 1) / 100 for i in range(50)])
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(F.lit(0)) for t in grid), F.lit(0))
    levels = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(reached.alias("reached"))
        .agg(
            F.sum(F.col(label).cast("long")).alias("pos"),
            F.sum(1 - F.col(label).cast("long")).alias("neg"),
        )
    )
    spark = df.sparkSession
    steps = spark.createDataFrame(
        [(i + 1, float(t)) for i, t in enumerate(grid)], "reached int, threshold double"
    )
    complete = steps.join(levels, "reached", "full")
    from_top = (
        Window.partitionBy(F.lit(0)).orderBy(F.col("reached").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    everything = Window.partitionBy(F.lit(0))
    pos, neg = F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0))
    counted = complete.select(
        "threshold",
        F.sum(pos).over(from_top).alias("tp"),
        F.sum(neg).over(from_top).alias("fp"),
        F.sum(pos).over(everything).alias("p"),
        F.sum(neg).over(everything).alias("q"),
    ).filter(F.col("threshold").isNotNull())
    n = F.col("p") + F.col("q")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return counted.select(
        "threshold",
        (ratio(F.col("tp"), n) - ratio(F.col("fp"), n) * odds).alias("net_benefit"),
        (ratio(F.col("p"), n) - ratio(F.col("q"), n) * odds).alias("treat_all"),
        F.lit(0.0).alias("treat_none"),
    )


def diagnostic_metrics(
    df: DataFrame, label: str, score: str, cut: float, by: Sequence[str] = ()
) -> DataFrame:
    """Sensitivity, specificity, predictive values, F1 in percent, and likelihood ratios at a cut."""
    kept = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = kept.groupBy(*by).agg(
        *[c.alias(n) for n, c in confusion_counts(label, score, cut).items()]
    )
    sens = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    spec = F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    return counts.select(
        *by,
        "tp", "fp", "fn", "tn",
        (100 * sens).alias("sensitivity"),
        (100 * spec).alias("specificity"),
        (100 * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ppv"),
        (100 * ratio(F.col("tn"), F.col("tn") + F.col("fn"))).alias("npv"),
        (100 * ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        F.try_divide(sens, 1 - spec).alias("lr_plus"),
        F.try_divide(1 - sens, spec).alias("lr_minus"),
    )


def hosmer_lemeshow(
    df: DataFrame, label: str, probability: str, n_groups: int = 10
) -> DataFrame:
    """Chi-square over quantile groups; groups that expect nothing or only events are skipped."""
    from riskloom.functions.tails import chi2_tail

    kept = df.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    steps = [i / n_groups for i in range(n_groups + 1)]
    cuts = [x for x in quantiles(kept, [probability], steps)[probability] if x is not None]
    edges = sorted(set(cuts))
    groups = kept.groupBy(edge_bin(F.col(probability), edges).alias("g")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(label).cast("double")).alias("observed"),
        F.sum(F.col(probability).cast("double")).alias("expected"),
    )
    usable = (F.col("expected") > 0) & (F.col("n") > F.col("expected"))
    off = F.col("observed") - F.col("expected")
    spread = F.col("expected") * (1 - F.col("expected") / F.col("n"))
    return groups.agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum(F.when(usable, off * off / spread)), F.lit(0.0)).alias("chi2"),
        F.greatest(F.count("*") - 2, F.lit(1)).alias("dof"),
    ).withColumn("p_value", chi2_tail("chi2", "dof"))


def subgroup_performance(
    df: DataFrame, label: str, scores: Sequence[str], dimensions: Mapping[str, Column],
    min_rows: int = 50, min_events: int = 10,
) -> DataFrame:
    """Event rate and AUROC of each score in every level of every dimension, in one pass.

    Rows are counted per score value and combination of levels first; only these counts are repeated per dimension.
    AUROC is null unless the level has more than ``min_rows`` rows and ``min_events`` events.
    """
    places = {d: f"_level{i}" for i, d in enumerate(dimensions)}
    levels = [c.cast("string").alias(places[d]) for d, c in dimensions.items()]
    pairs = F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("s")) for s in scores])
    scored = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("y"), *levels, F.inline(pairs))
    counted = score_histogram(scored, "y", "s", [*places.values(), "score_name"])
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("level")) for d, c in places.items()])
    by = ["dimension", "level", "score_name"]
    hist = (
        counted.select("score_name", "score", "pos", "neg", F.inline(each))
        .filter(F.col("level").isNotNull())
        .groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    measured = rank_measures(running_sums(cut_lineage(hist), "score", ["pos", "neg"], by), by)
    n = F.col("n_pos") + F.col("n_neg")
    enough = (n > min_rows) & (F.col("n_pos") >= min_events)
    return measured.select(
        *by,
        n.alias("n"),
        F.col("n_pos").alias("events"),
        (100 * ratio(F.col("n_pos"), n)).alias("event_pct"),
        F.when(enough, F.col("auroc")).alias("auroc"),
    )


def event_rate_by(df: DataFrame, label: str, group: Column | str) -> DataFrame:
    """Count, events and event rate per value of a score or group."""
    group = F.col(group) if isinstance(group, str) else group
    return df.groupBy(group.alias("value")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(label).cast("long")).alias("events"),
        F.avg(F.col(label).cast("double")).alias("event_rate"),
    )


def event_rate_interval(df: DataFrame, label: str, group: str, z: float = 1.959963984540054) -> DataFrame:
    """Event rate per group with the Wilson interval."""
    rates = event_rate_by(df.filter(F.col(label).isNotNull()), label, group)
    n, p, z2 = F.col("n"), F.col("event_rate"), z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return rates.withColumns({"ci_low": centre - half, "ci_high": centre + half})


def cohort_characteristics(
    df: DataFrame, label: str, age: str, flags: Mapping[str, Column]
) -> DataFrame:
    """Long table of (stat, value): size, event rate, age moments and quartiles, shares in percent."""
    q1, median, q3 = quantiles(df, [age], [0.25, 0.5, 0.75])[age]
    row = df.agg(
        F.count("*").cast("double").alias("n_total"),
        F.sum(F.col(label).cast("double")).alias("n_events"),
        (100 * F.avg(F.col(label).cast("double"))).alias("event_pct"),
        F.avg(age).alias("age_mean"),
        F.stddev_samp(age).alias("age_sd"),
        *[F.count_if(c).cast("double").alias(f"n_{k}") for k, c in flags.items()],
        *[
            (100.0 * F.count_if(c) / F.count("*")).alias(f"pct_{k}")
            for k, c in flags.items()
        ],
    ).withColumns(
        {
            "age_q1": F.lit(q1).cast("double"),
            "age_median": F.lit(median).cast("double"),
            "age_q3": F.lit(q3).cast("double"),
        }
    )
    return row.unpivot([], row.columns, "stat", "value")
