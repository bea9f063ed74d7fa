"""Dataset analysis in one row, and advice rows from a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.association import pearson_pairs
from riskloom.operators.features import low_variance_columns
from riskloom.operators.profile import numeric_columns, sample_skewness

# Fixed values: (technique, category, priority, condition on the analysis row)
RULES = [
    ("SMOTE", "imbalance", "high", "is_imbalanced"),
    ("class_weight", "imbalance", "high", "is_imbalanced"),
    ("xgb_balanced", "model", "high", "is_imbalanced AND imbalance_ratio > 5"),
    ("simple_imputation", "preprocessing", "medium", "missing_pct > 0 AND missing_pct < 5"),
    ("knn_imputation", "preprocessing", "high", "missing_pct >= 5 AND missing_pct < 20"),
    ("iterative_imputation", "preprocessing", "medium", "missing_pct >= 5 AND missing_pct < 20"),
    ("missing_indicator", "feature_engineering", "high", "missing_pct >= 20"),
    ("remove_correlated", "feature_engineering", "medium", "n_correlated_pairs > 0"),
    ("pca", "feature_engineering", "low", "n_correlated_pairs > 0"),
    ("log_transform", "preprocessing", "medium", "n_skewed > 0"),
    ("variance_threshold", "feature_engineering", "low", "n_low_variance > 0"),
    ("logistic_regression", "model", "high", "size_class = 'small'"),
    ("xgboost", "model", "high", "size_class IN ('large', 'very_large')"),
    ("catboost", "model", "medium", "n_categorical > 5"),
    ("automl", "model", "medium", "true"),
    ("repeated_cv", "evaluation", "medium", "n_samples < 1000"),
    ("auprc", "evaluation", "high", "is_imbalanced"),
]
# Upper row counts of the size classes
SIZE_CLASSES = [(500, "small"), (5_000, "medium"), (50_000, "large")]


def analyse(df: DataFrame, target: str) -> DataFrame:
    """One row: size, column kinds, class ratio, mean missing percent, correlated, flat, skewed columns."""
    features = [f for f in df.schema.fields if f.name != target]
    names = [f.name for f in features]
    numeric = [c for c in numeric_columns(df) if c != target]
    text = [f.name for f in features if isinstance(f.dataType, T.StringType)]
    dated = [f.name for f in features if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    missing = sum((1 - F.count(c) / F.count("*") for c in names), F.lit(0.0))
    skewed = sum(
        (F.coalesce((F.abs(sample_skewness(c)) > 1).cast("int"), F.lit(0)) for c in numeric), F.lit(0)
    )
    row = df.agg(
        F.count("*").alias("n_samples"),
        F.lit(len(names)).alias("n_features"),
        F.lit(len(numeric)).alias("n_numeric"),
        F.lit(len(text)).alias("n_categorical"),
        F.lit(bool(dated)).alias("has_datetime"),
        (100 * missing / len(names)).alias("missing_pct"),
        skewed.alias("n_skewed"),
    )
    classes = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")).agg(
        F.struct(F.count("*").alias("k"), (F.max("n") / F.min("n")).alias("ratio"))
    ).scalar()
    pairs = pearson_pairs(df, numeric).agg(F.count_if(F.abs("r") > 0.9)).scalar()
    flat = low_variance_columns(df, numeric).agg(F.count("*")).scalar()
    size = F
    for limit, name in SIZE_CLASSES:
        size = size.when(F.col("n_samples") < limit, name)
    return row.withColumns(
        {
            "n_classes": classes["k"],
            "imbalance_ratio": classes["ratio"],
            "is_imbalanced": classes["ratio"] > 3,
            "n_correlated_pairs": pairs,
            "n_low_variance": flat,
            "size_class": size.otherwise("very_large"),
        }
    )


def advice(analysis: DataFrame) -> DataFrame:
    """Advice rows (technique, category, priority, position), most urgent first."""
    order = {"high": 0, "medium": 1, "low": 2}
    entries = [
        F.when(
            F.expr(condition),
            F.struct(
                F.lit(order[priority]).alias("urgency"), F.lit(i).alias("position"),
                F.lit(technique).alias("technique"), F.lit(category).alias("category"),
                F.lit(priority).alias("priority"),
            ),
        )
        for i, (technique, category, priority, condition) in enumerate(RULES)
    ]
    rows = analysis.select(F.explode(F.array_compact(F.array(*entries))).alias("a")).select("a.*")
    return rows.orderBy("urgency", "position").drop("urgency")
