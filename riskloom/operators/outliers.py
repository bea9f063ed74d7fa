"""Outlier detection and treatment: fit a small bounds table once, apply it as a projection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.quantiles import clean_double, quantiles

METHODS = ("none", "iqr", "zscore", "modified_zscore", "percentile", "isolation_forest", "lof")
TREATMENTS = ("none", "cap", "remove", "transform")
# Fixed value: 0.75 quantile of the standard normal as the method writes it
MAD_SCALE = 0.6745


@dataclass(frozen=True)
class OutlierRule:
    method: str = "iqr"
    treatment: str = "cap"
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    modified_zscore_threshold: float = 3.5
    lower_percentile: float = 1.0
    upper_percentile: float = 99.0
    contamination: float = 0.1
    lof_neighbors: int = 20

    def __post_init__(self):
        if self.method not in METHODS or self.treatment not in TREATMENTS:
            raise ValueError(f"unknown outlier rule {self.method!r} / {self.treatment!r}")


@dataclass
class FittedOutliers:
    """Everything needed to flag and treat one column on new rows."""

    column: str
    rule: OutlierRule
    low: float | None = None  # cap bounds; also the flag bounds of iqr and percentile
    high: float | None = None
    centre: float | None = None
    scale: float | None = None
    minimum: float | None = None
    all_positive: bool = False
    score_cut: float | None = None
    flag_table: DataFrame | None = field(default=None, repr=False)  # flagged values, one per row
    scorer: object | None = field(default=None, repr=False)  # column -> anomaly score column

    def flag(self) -> Column:
        x, rule = clean_double(F.col(self.column)), self.rule
        if rule.method in ("iqr", "percentile"):
            if self.low is None:
                return F.lit(False)
            return F.coalesce((x < F.lit(self.low)) | (x > F.lit(self.high)), F.lit(False))
        if rule.method in ("zscore", "modified_zscore"):
            if not self.scale:
                return F.lit(False)
            limit = rule.zscore_threshold
            factor = 1.0
            if rule.method == "modified_zscore":
                limit, factor = rule.modified_zscore_threshold, MAD_SCALE
            distance = F.abs(F.lit(factor) * (x - F.lit(self.centre)) / F.lit(self.scale))
            return F.coalesce(distance > F.lit(limit), F.lit(False))
        if self.flag_table is not None:
            return F.col(f"_flag_{self.column}").isNotNull()
        if self.scorer is not None:
            return F.coalesce(self.scorer(x) > F.lit(self.score_cut), F.lit(False))
        return F.lit(False)

    def treated(self) -> Column:
        x, treatment = F.col(self.column), self.rule.treatment
        if self.rule.method == "none" or treatment == "none":
            return x
        flag = self.flag()
        if treatment == "remove":
            return F.when(~flag, x)
        if treatment == "cap":
            if self.low is None:
                return x
            low, high = F.lit(self.low), F.lit(self.high)
            return F.when(flag & (x < low), low).when(flag & (x > high), high).otherwise(x.cast("double"))
        value = x.cast("double")
        if self.minimum is None:
            return value
        if self.all_positive:
            return F.log1p(value)
        if self.minimum <= 0:
            return F.sqrt(value - F.lit(self.minimum) + 1.0)
        return F.sqrt(value)


class OutlierModel:
    def __init__(self, fitted: Mapping[str, FittedOutliers]):
        self.fitted = dict(fitted)

    def _flagged(self, df: DataFrame) -> DataFrame:
        """Join the flagged values of methods that decide per distinct value."""
        for c, f in self.fitted.items():
            if f.flag_table is not None:
                values = f.flag_table.select(F.col("value").alias(f"_flag_{c}"))
                df = df.join(values, clean_double(F.col(c)) == F.col(f"_flag_{c}"), "left")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        treated = self._flagged(df).withColumns({c: f.treated() for c, f in self.fitted.items()})
        return treated.select(*df.columns)

    def flags(self, df: DataFrame, suffix: str = "_outlier") -> DataFrame:
        marks = {f"{c}{suffix}": f.flag() for c, f in self.fitted.items()}
        return self._flagged(df).withColumns(marks).select(*df.columns, *marks)

    def counts(self, df: DataFrame) -> dict[str, int]:
        """Flagged values per column (also when the treatment is none)."""
        if not self.fitted:
            return {}
        flagged = self._flagged(df)
        row = flagged.agg(*[F.count_if(f.flag()).alias(c) for c, f in self.fitted.items()]).first()
        return {c: row[c] for c in self.fitted}

    def bounds_table(self, df: DataFrame) -> DataFrame:
        counts = self.counts(df)
        return df.sparkSession.createDataFrame(
            [
                (c, f.rule.method, f.rule.treatment, f.low, f.high, counts[c])
                for c, f in self.fitted.items()
            ],
            "variable string, method string, treatment string, low double, high double, n_outliers long",
        )


def fit_outliers(df: DataFrame, rules: Mapping[str, OutlierRule]) -> OutlierModel:
    """Fit all columns together: one scan for moments, one quantile job per distinct need."""
    rules = {c: r for c, r in rules.items() if r.method != "none"}
    fitted = {c: FittedOutliers(c, r) for c, r in rules.items()}
    if not fitted:
        return OutlierModel({})
    x = {c: clean_double(F.col(c)) for c in fitted}
    row = df.agg(
        *[
            F.struct(
                F.avg(x[c]).alias("mean"),
                F.stddev_pop(x[c]).alias("sd"),
                F.min(x[c]).alias("low"),
                F.count_if(x[c].isNull() | (x[c] <= 0)).alias("not_positive"),
            ).alias(c)
            for c in fitted
        ]
    ).first()
    for c, f in fitted.items():
        f.minimum, f.all_positive = row[c].low, row[c].not_positive == 0
        if f.rule.method == "zscore":
            f.centre, f.scale = row[c].mean, row[c].sd

    probs: dict[tuple[float, ...], list[str]] = {}
    for c, f in fitted.items():
        need = {
            "iqr": (0.25, 0.75),
            "percentile": (f.rule.lower_percentile / 100, f.rule.upper_percentile / 100),
            "modified_zscore": (0.5,),
        }.get(f.rule.method, (0.01, 0.99))
        probs.setdefault(need, []).append(c)
    for need, columns in probs.items():
        found = quantiles(df, {c: x[c] for c in columns}, need)
        for c in columns:
            f, values = fitted[c], found[c]
            if values[0] is None:
                continue
            if f.rule.method == "iqr":
                spread = f.rule.iqr_multiplier * (values[1] - values[0])
                f.low, f.high = values[0] - spread, values[1] + spread
            elif f.rule.method == "modified_zscore":
                f.centre = values[0]
            else:
                f.low, f.high = values
    robust = [c for c, f in fitted.items() if f.rule.method == "modified_zscore" and f.centre is not None]
    if robust:
        deviation = {c: F.abs(x[c] - F.lit(fitted[c].centre)) for c in robust}
        for c, (mad,) in quantiles(df, deviation, [0.5]).items():
            f = fitted[c]
            f.scale = mad
            reach = f.rule.modified_zscore_threshold * mad / MAD_SCALE
            f.low, f.high = f.centre - reach, f.centre + reach
    for c, f in fitted.items():
        if f.rule.method == "isolation_forest":
            from riskloom.plans.anomaly import fit_column_forest

            fit_column_forest(df, f)
        elif f.rule.method == "lof":
            from riskloom.operators.local_outliers import fit_column_lof

            fit_column_lof(df, f)
    return OutlierModel(fitted)
