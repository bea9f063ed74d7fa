"""Iterative imputation: each column with gaps is predicted from the others, round after round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.quantiles import quantiles
from riskloom.session import cut_lineage


def chained_imputation(
    df: DataFrame, key: str, columns: Sequence[str], rounds: int = 10, learner: str = "gbt", seed: int = 42
) -> DataFrame:
    """Start from medians; refit every incomplete column on its observed rows, predict its gaps."""
    medians = quantiles(df, columns, [0.5])
    known = {c: F.col(c).isNotNull().alias(f"_known_{c}") for c in columns}
    state = cut_lineage(
        df.select(
            key, *known.values(),
            *[F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0])).alias(c) for c in columns],
        )
    )
    row = state.agg(*[F.count_if(~F.col(f"_known_{c}")).alias(c) for c in columns]).first()
    gaps = sorted((c for c in columns if row[c] > 0), key=lambda c: (row[c], c))
    for _ in range(rounds if gaps else 0):
        for c in gaps:
            others = [o for o in columns if o != c]
            common = {"featuresCol": "_features", "labelCol": c, "predictionCol": "_guess"}
            learn = (
                GBTRegressor(**common, maxIter=10, maxDepth=3, seed=seed)
                if learner == "gbt"
                else LinearRegression(**common)
            )
            pipeline = Pipeline(stages=[VectorAssembler(inputCols=others, outputCol="_features"), learn])
            model = pipeline.fit(state.filter(f"_known_{c}"))
            guess = F.when(F.col(f"_known_{c}"), F.col(c)).otherwise(F.col("_guess"))
            state = model.transform(state).withColumn(c, guess).drop("_features", "_guess")
        state = cut_lineage(state)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest).join(state.select(key, *columns), key)
