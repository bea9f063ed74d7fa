"""Feature ranking and selection from table statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.tails import t_tail
from riskloom.operators.association import pearson_pairs
from riskloom.operators.quantiles import clean_double, quantiles


def target_ranking(df: DataFrame, target: str, columns: Sequence[str], min_valid: int = 100) -> DataFrame:
    """Absolute correlation of each feature with a 0/1 target, p-value, missing share; best first."""
    cleaned = df.select(
        clean_double(F.col(target)).alias("_y"), *[clean_double(F.col(c)).alias(c) for c in columns]
    )
    row = cleaned.agg(
        *[
            F.struct(
                F.abs(F.nanvl(F.corr(c, "_y"), F.lit(None).cast("double"))).alias("r"),
                F.count_if(F.col(c).isNotNull() & F.col("_y").isNotNull()).alias("n"),
                (1 - F.count(c) / F.count("*")).alias("missing_share"),
            ).alias(c)
            for c in columns
        ]
    )
    long = row.unpivot([], list(columns), "variable", "s").select("variable", "s.*")
    dof = (F.col("n") - 2).cast("double")
    t = F.when(F.col("r") < 1, F.col("r") * F.sqrt(dof / (1 - F.col("r") * F.col("r")))).when(
        F.col("r").isNotNull(), F.lit(float("inf"))
    )
    return (
        long.filter((F.col("n") >= min_valid) & F.col("r").isNotNull())
        .withColumn("p_value", t_tail(t, dof))
        .orderBy(F.desc("r"), "variable")
    )


def usable_features(ranking: DataFrame, max_p: float = 0.05, max_missing: float = 0.3) -> DataFrame:
    return ranking.filter((F.col("p_value") < max_p) & (F.col("missing_share") < max_missing))


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> list[str]:
    """Later column of every pair with abs(r) above the limit."""
    place = {c: i for i, c in enumerate(columns)}
    pairs = pearson_pairs(df, columns).filter(F.abs("r") > limit).select("b").distinct().collect()
    return sorted((r.b for r in pairs), key=place.__getitem__)


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.var_samp(clean_double(F.col(c))).alias(c) for c in columns])
    return row.unpivot([], list(columns), "variable", "variance")


def low_variance_columns(df: DataFrame, columns: Sequence[str], share: float = 0.05) -> DataFrame:
    """Columns whose variance lies below the 5 % quantile of all column variances."""
    table = variances(df, columns)
    cut = quantiles(table, ["variance"], [share])["variance"][0]
    return table.filter(F.col("variance") < F.lit(cut))
