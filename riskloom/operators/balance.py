"""Class imbalance: detection, weights, exact-size resampling by hash, and the before/after report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_order
from riskloom.operators.split import class_counts, first_rows


def imbalance(df: DataFrame, target: str, threshold: float = 3.0, has_categorical: bool = False) -> DataFrame:
    """One row: largest and smallest class, their ratio, whether imbalanced, and the advised strategy."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    row = counts.agg(F.max("n").alias("n_max"), F.min("n").alias("n_min"), F.count("*").alias("n_classes"))
    ratio = F.col("n_max") / F.col("n_min")
    return row.withColumns(
        {
            "ratio": ratio,
            "is_imbalanced": ratio >= threshold,
            "strategy": recommended_strategy(ratio, has_categorical, threshold),
        }
    )


def recommended_strategy(ratio: Column, has_categorical: bool, threshold: float = 3.0) -> Column:
    pick = (lambda plain, mixed: F.lit(mixed if has_categorical else plain))
    return (
        F.when(ratio < threshold, "none")
        .when(ratio > 20, pick("smote_tomek", "class_weight"))
        .when(ratio > 10, pick("adasyn", "smote_nc"))
        .when(ratio > 5, pick("smote", "smote_nc"))
        .otherwise("class_weight")
    )


def class_weights(df: DataFrame, target: str, strategy: str = "balanced") -> DataFrame:
    """Weight n / (k * n_c) per class, or its square root."""
    if strategy not in ("balanced", "sqrt_balanced"):
        raise ValueError(f"unknown strategy {strategy!r}")
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    weight = whole["n"] / (whole["k"] * F.col("n"))
    return counts.withColumn("weight", weight if strategy == "balanced" else F.sqrt(weight))


def with_class_weight(df: DataFrame, target: str, strategy: str = "balanced") -> DataFrame:
    """Add a ``weight`` column. The class table has one row per class, and a join on so few keys must not deal the rows
    by class: they would all land in as many tasks as there are classes. So that table is sent to the rows."""
    return df.join(F.broadcast(class_weights(df, target, strategy).drop("n")), target)


def positive_weight_ratio(df: DataFrame, target: str) -> DataFrame:
    """Weight of class 1 over weight of class 0, the form boosted trees take."""
    return df.agg(
        F.try_divide(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).alias("scale_pos_weight")
    )


def under_sample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Each class cut to the size of the smallest, keeping its first rows in hash order."""
    counts = class_counts(df, target)
    size = min(counts.values())
    keep = first_rows(df, [hash_order(key, seed)], key, {v: [size] for v in counts}, target)[0]
    condition = F.lit(False)
    for c in keep.values():
        condition = condition | F.coalesce(c, F.lit(False))
    return df.filter(condition)


def over_sample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Each class repeated to the size of the largest; ``copy`` numbers the repeats from 0.

    Rows are repeated equally often; the first rows in hash order get one more until the size is met.
    """
    counts = class_counts(df, target)
    size = max(counts.values())
    extra = {v: [size % n] for v, n in counts.items()}
    more = first_rows(df, [hash_order(key, seed)], key, extra, target)[0]
    copies = F.lit(1)
    for v, n in counts.items():
        test = F.col(target).isNull() if v is None else F.col(target) == F.lit(v)
        once = F.lit(size // n) + F.when(more[(v, size % n)], 1).otherwise(F.lit(0))
        copies = F.when(test, once).otherwise(copies)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))


def balance_report(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """Per class: rows before and after, rows added, and the imbalance ratio on both sides."""
    count = lambda t, name: t.groupBy(target).agg(F.count("*").alias(name))
    a, b = count(before, "n_before"), count(after, "n_after")
    joined = a.join(b, target, "full").select(
        F.col(target).cast("string").alias("class"),
        F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"),
    )
    ratio = lambda t, n: t.agg(F.max(n) / F.min(n)).scalar()
    return joined.withColumn("added", F.col("n_after") - F.col("n_before")).withColumns(
        {"ratio_before": ratio(a, "n_before"), "ratio_after": ratio(b, "n_after")}
    )
