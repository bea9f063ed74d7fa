"""Table cleaning as fit / transform: facts and parameters are fitted once, rows are only projected.

Order: columns, duplicate rows, outliers, missing values, bins, codes, types. The target is left as
it is. A fitted model can be applied to new rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import binning, encode, impute
from riskloom.operators.outliers import OutlierModel, OutlierRule, fit_outliers
from riskloom.operators.profile import ColumnFacts, column_facts


@dataclass
class CleaningConfig:
    """Global defaults; the ``custom_*`` fields override them per column."""

    numeric_imputation: str = "none"
    categorical_imputation: str = "none"
    knn_neighbors: int = 5
    constant_fill_numeric: float = 0.0
    constant_fill_categorical: str = "missing"
    custom_imputation: Mapping[str, str] = field(default_factory=dict)
    custom_constants: Mapping[str, object] = field(default_factory=dict)
    columns_to_drop: Sequence[str] = ()
    outliers: OutlierRule = OutlierRule("none", "none")
    custom_outliers: Mapping[str, OutlierRule] = field(default_factory=dict)
    columns_skip_outliers: Sequence[str] = ()
    categorical_encoding: str = "label"
    ordinal_categories: Mapping[str, Sequence[str]] = field(default_factory=dict)
    custom_encoding: Mapping[str, str] = field(default_factory=dict)
    discretization: str = "none"
    discretization_bins: int = 5
    custom_edges: Mapping[str, Sequence[float]] = field(default_factory=dict)
    custom_labels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    custom_discretization: Mapping[str, str] = field(default_factory=dict)
    custom_bins: Mapping[str, int] = field(default_factory=dict)
    drop_duplicates: bool = True
    drop_fully_missing: bool = True
    drop_constant: bool = True
    constant_threshold: float = 0.95
    drop_target: bool = False  # True lets the constant rule remove the target as well


def columns_to_remove(
    facts: Sequence[ColumnFacts], config: CleaningConfig, protected: Sequence[str]
) -> dict[str, str]:
    """Columns to remove with the reason: by request, without values, or nearly constant."""
    removed = {}
    for f in facts:
        if f.name in config.columns_to_drop:
            removed[f.name] = "dropped_by_user"
        elif f.name in protected:
            continue
        elif config.drop_fully_missing and f.n_present == 0:
            removed[f.name] = "fully_missing"
        elif config.drop_constant and (f.majority_share or 0.0) >= config.constant_threshold:
            removed[f.name] = "nearly_constant"
    return removed


def drop_duplicate_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """One row per distinct content; with a key column, the row with the smallest key stays.

    Copies are combined before the shuffle, so a row copied millions of times stays cheap.
    """
    if key is None:
        return df.dropDuplicates()
    content = [c for c in df.columns if c != key]
    return df.groupBy(*content).agg(F.min(key).alias(key)).select(*df.columns)


@dataclass
class CleaningModel:
    config: CleaningConfig
    target: str | None
    key: str | None
    removed: dict[str, str]
    numeric: list[str]
    categorical: list[str]
    outliers: OutlierModel
    fills: dict[str, object]
    ordered_fills: dict[str, str]
    knn_columns: list[str]
    bins: dict[str, binning.Bins]
    encoders: dict[str, tuple[str, object]]
    retyped: list[str]
    donors: DataFrame | None = field(default=None, repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        """Clean rows with the fitted parameters; duplicates are a property of the fitted table only."""
        df = df.drop(*[c for c in self.removed if c in df.columns])
        df = _fill(self, self.outliers.transform(df))
        df = binning.apply_bins(df, self.bins) if self.bins else df
        return _encode(self, df)


def _fill(model: CleaningModel, df: DataFrame) -> DataFrame:
    for direction in ("forward", "backward"):
        columns = [c for c, d in model.ordered_fills.items() if d == direction]
        if columns:
            df = impute.fill_ordered(df, columns, model.key, backward=direction == "backward")
    if model.knn_columns:
        from riskloom.operators.masked import knn_impute

        df = knn_impute(
            df, model.key, model.knn_columns, model.config.knn_neighbors, donors=model.donors
        )
    return impute.apply_fills(df, model.fills)


def _encode(model: CleaningModel, df: DataFrame) -> DataFrame:
    for column, (kind, fitted) in model.encoders.items():
        if kind == "label":
            df = encode.encode_labels(df, column, fitted)
        elif kind == "onehot":
            df = encode.encode_one_hot(df, column, fitted)
        else:
            df = df.withColumn(column, encode.ordinal_code(column, fitted))
    return df.withColumns({c: F.col(c).try_cast("double") for c in model.retyped})


def fit_cleaning(
    df: DataFrame, config: CleaningConfig, target: str | None = None, key: str | None = None
) -> tuple[CleaningModel, DataFrame]:
    """Fit on a table; returns the model and the cleaned table (duplicates removed)."""
    facts = column_facts(df, threshold=config.constant_threshold)
    if not facts or facts[0].n_rows == 0:
        raise ValueError("cannot clean an empty table")
    protected = [c for c in (key, None if config.drop_target else target) if c]
    removed = columns_to_remove(facts, config, protected)
    kept = [f for f in facts if f.name not in removed and f.name not in (target, key)]
    numeric = [f.name for f in kept if f.is_numeric]
    categorical = [f.name for f in kept if not f.is_numeric]
    base = df.drop(*removed)
    if config.drop_duplicates:
        base = drop_duplicate_rows(base, key)

    rules = {
        c: config.custom_outliers.get(c, config.outliers)
        for c in numeric
        if c not in config.columns_skip_outliers
    }
    outliers = fit_outliers(base, rules)
    stage = outliers.transform(base)

    strategies = {
        c: config.custom_imputation.get(
            c, config.numeric_imputation if c in numeric else config.categorical_imputation
        )
        for c in numeric + categorical
    }
    constants = {c: config.constant_fill_numeric for c in numeric}
    constants |= {c: config.constant_fill_categorical for c in categorical}
    constants |= dict(config.custom_constants)
    ordered = {c: s for c, s in strategies.items() if s in ("forward", "backward")}
    if ordered and key is None:
        raise ValueError("forward and backward fills need a key column that orders the rows")
    knn = [c for c, s in strategies.items() if s == "knn"]
    plain = {c: s for c, s in strategies.items() if s not in ("knn",)}
    model = CleaningModel(
        config, target, key, removed, numeric, categorical, outliers,
        impute.fit_fills(stage, plain, constants), ordered, knn, {}, {}, [],
        stage if knn else None,
    )
    stage = _fill(model, stage)

    for c in numeric:
        strategy = config.custom_discretization.get(c, config.discretization)
        if strategy != "none":
            model.bins[c] = binning.fit_bins(
                stage, c, strategy, config.custom_bins.get(c, config.discretization_bins),
                config.custom_edges.get(c), config.custom_labels.get(c),
            )
    if model.bins:
        stage = binning.apply_bins(stage, model.bins)

    for c in categorical:
        kind = config.custom_encoding.get(c, config.categorical_encoding)
        if kind == "ordinal" and c not in config.ordinal_categories:
            kind = "label"
        if kind == "label":
            model.encoders[c] = (kind, encode.fit_labels(stage, c))
        elif kind == "onehot":
            model.encoders[c] = (kind, encode.fit_one_hot(stage, c))
        elif kind == "ordinal":
            model.encoders[c] = (kind, list(config.ordinal_categories[c]))
        elif kind != "none":
            raise ValueError(f"unknown encoding {kind!r} for {c!r}")
    left_as_text = [c for c in stage.columns if c not in model.encoders and c not in (target, key)]
    model.retyped = encode.numeric_text_columns(stage, left_as_text)
    return model, _encode(model, stage)


def quick_clean(
    df: DataFrame, target: str | None = None, key: str | None = None, **settings
) -> DataFrame:
    return fit_cleaning(df, CleaningConfig(**settings), target, key)[1]


def variable_metadata(
    before: DataFrame, after: DataFrame, model: CleaningModel, descriptions: DataFrame | None = None
) -> DataFrame:
    """One row per variable: kind, types, range and missing counts before and after, treatment, flags."""
    first, last = _ranges(before, "before"), _ranges(after, "after")
    counts = model.outliers.counts(before.drop(*model.removed))
    rows = []
    for c in before.columns:
        if c in (model.target, model.key):
            continue
        fitted = model.outliers.fitted.get(c)
        rows.append(
            (
                c,
                "numeric" if c in model.numeric else "categorical",
                fitted.rule.method if fitted else "none",
                fitted.rule.treatment if fitted else "none",
                counts.get(c, 0),
                model.encoders[c][0] if c in model.encoders else "none",
                c in model.fills or c in model.ordered_fills or c in model.knn_columns,
                c in model.bins,
                model.removed.get(c),
            )
        )
    table = before.sparkSession.createDataFrame(
        rows,
        "variable string, kind string, outlier_method string, outlier_treatment string, "
        "outliers_treated long, encoding string, imputed boolean, binned boolean, quality_flag string",
    )
    table = table.join(first, "variable", "left").join(last, "variable", "left")
    return table.join(descriptions, "variable", "left") if descriptions is not None else table


def _ranges(df: DataFrame, tag: str) -> DataFrame:
    row = df.agg(
        *[
            F.struct(
                F.lit(kind).alias(f"dtype_{tag}"),
                (F.min(c).cast("double") if kind not in ("string", "boolean") else F.lit(None).cast("double")).alias(f"min_{tag}"),
                (F.max(c).cast("double") if kind not in ("string", "boolean") else F.lit(None).cast("double")).alias(f"max_{tag}"),
                (F.count("*") - F.count(c)).alias(f"missing_{tag}"),
            ).alias(c)
            for c, kind in df.dtypes
            if not kind.startswith(("timestamp", "date"))
        ]
    )
    return row.unpivot([], row.columns, "variable", "s").select("variable", "s.*")


def category_values(df: DataFrame, columns: Sequence[str], limit: int = 50) -> DataFrame:
    """Up to ``limit`` example categories per variable (smallest first), for the metadata table."""
    from pyspark.sql import Window

    from riskloom.operators.profile import value_counts

    order = Window.partitionBy("variable").orderBy("value")
    return (
        value_counts(df, columns)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .drop("n")
    )


def cleaning_report(metadata: DataFrame) -> DataFrame:
    """Totals over the metadata table."""
    return metadata.agg(
        F.count("*").alias("n_variables"),
        F.count_if("imputed").alias("n_imputed"),
        F.count_if(F.col("encoding") != "none").alias("n_encoded"),
        F.count_if("binned").alias("n_binned"),
        F.sum("outliers_treated").alias("outliers_treated"),
        F.sum("missing_before").alias("missing_before"),
        F.sum("missing_after").alias("missing_after"),
        F.count("quality_flag").alias("n_removed"),
    )
