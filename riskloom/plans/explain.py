"""Explanation jobs on a fitted pipeline: the model is applied by Spark, rows never leave the cluster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_order
from riskloom.operators.evaluate import rank_measures, ranked_scores
from riskloom.operators.prefix import running_sums
from riskloom.operators.quantiles import quantiles
from riskloom.plans.models import with_score
from riskloom.plans.trees import ensemble_of, tree_attributions
from riskloom.session import cut_lineage, drop_table, spread


def _ranked_by_hash(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Key with its place 0.. in hash order, computed range by range; rows of one hash follow their keys."""
    rows = df.select(key, hash_order(key, seed).alias("h"), F.lit(1).cast("long").alias("one"))
    per_hash = rows.groupBy("h").agg(F.sum("one").alias("one"), F.sort_array(F.collect_list(key)).alias("keys"))  # a hash has few keys
    places = running_sums(per_hash, "h", ["one"]).select("one_before", F.posexplode("keys").alias("i", key))
    return places.select(key, (F.col("one_before") + F.col("i")).alias("place"))


def permutation_importance(
    df: DataFrame, model: PipelineModel, features: Sequence[str], key: str, repeats: int = 10, seed: int = 42
) -> DataFrame:
    """(feature, mean, std) drop of AUROC when one feature is shuffled among the rows.

    Row i in one hash order receives the value of row i in another: a join on places, no global sort.
    """
    base = rank_measures(ranked_scores(with_score(model.transform(df)), "label", "score")).first().auroc
    home = cut_lineage(_ranked_by_hash(df, key, f"{seed}-home"))
    parts = []
    for r in range(repeats):
        donor = _ranked_by_hash(df, key, f"{seed}-{r}").withColumnRenamed(key, "_donor")
        mapping = home.join(donor, "place").select(key, "_donor")
        values = df.select(F.col(key).alias("_donor"), *[F.col(c).alias(f"_v_{c}") for c in features])
        mixed = cut_lineage(df.join(mapping, key).join(values, "_donor").drop("_donor"))
        for c in features:
            shuffled = mixed.withColumn(c, F.col(f"_v_{c}")).drop(*[f"_v_{f}" for f in features])
            parts.append(
                with_score(model.transform(shuffled)).select(
                    F.lit(c).alias("feature"), F.lit(r).alias("repeat"), "label", "score"
                )
            )
    scored = cut_lineage(reduce(DataFrame.unionByName, parts))
    by = ["feature", "repeat"]
    drops = rank_measures(ranked_scores(scored, "label", "score", by), by)
    return drops.groupBy("feature").agg(
        F.avg(F.lit(base) - F.col("auroc")).alias("mean"),
        F.stddev_pop(F.lit(base) - F.col("auroc")).alias("std"),
    )


def partial_dependence(
    df: DataFrame, model: PipelineModel, features: Sequence[str], grid: int = 20, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """(feature, value, mean_score) over an even grid between two quantiles.

    Each row is scored at every grid value of one feature (a fixed number of copies per row) and
    averaged on the map side.
    """
    ends = quantiles(df, features, [low, high])
    parts = []
    for c in features:
        a, b = ends[c]
        steps = [a + (b - a) * i / (grid - 1) for i in range(grid)]
        copies = df.withColumn(c, F.explode(F.array(*[F.lit(s) for s in steps])))
        scored = with_score(model.transform(copies))
        parts.append(
            scored.groupBy(F.col(c).alias("value")).agg(F.avg("score").alias("mean_score"))
            .select(F.lit(c).alias("feature"), "value", "mean_score")
        )
    return reduce(DataFrame.unionByName, parts)


def linear_attributions(
    df: DataFrame, weights: Mapping[str, float], key: str, means: Mapping[str, float] | None = None
) -> DataFrame:
    """(key, feature, attribution): exact Shapley values of a linear score, w * (x - mean)."""
    if means is None:
        means = df.agg(*[F.avg(c).alias(c) for c in weights]).first().asDict()
    row = df.select(key, *[(F.lit(float(w)) * (F.col(c) - F.lit(means[c]))).alias(c) for c, w in weights.items()])
    return row.unpivot([key], list(weights), "feature", "attribution")


def sampled_attributions(
    df: DataFrame, model: PipelineModel, features: Sequence[str], key: str, samples: int = 20, seed: int = 42
) -> DataFrame:
    """(key, feature, attribution): permutation-sampling Shapley values of any model's score.

    Per sample a row is mixed with a background row (another row by hash place) along one feature
    order; each step switches one feature to the row's own value and its score change is credited.
    """
    home = cut_lineage(_ranked_by_hash(df, key, f"{seed}-home"))
    parts = []
    for s in range(samples):
        order = _order(features, s, seed)
        donor = _ranked_by_hash(df, key, f"{seed}-bg-{s}").withColumnRenamed(key, "_donor")
        mapping = home.join(donor, "place").select(key, "_donor")
        values = df.select(F.col(key).alias("_donor"), *[F.col(c).alias(f"_b_{c}") for c in features])
        mixed = df.join(mapping, key).join(values, "_donor").drop("_donor")
        steps = mixed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(order)))))
        switched = steps.withColumns(
            {
                c: F.when(F.col("step") > order.index(c), F.col(c)).otherwise(F.col(f"_b_{c}"))
                for c in features
            }
        ).drop(*[f"_b_{c}" for c in features])
        scored = with_score(model.transform(switched)).select(key, "step", "score")
        wide = scored.groupBy(key).agg(
            *[F.max(F.when(F.col("step") == i, F.col("score"))).alias(f"s{i}") for i in range(len(order) + 1)]
        )
        credit = wide.select(key, *[(F.col(f"s{i + 1}") - F.col(f"s{i}")).alias(c) for i, c in enumerate(order)])
        parts.append(credit.unpivot([key], list(order), "feature", "v"))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy(key, "feature").agg(F.avg("v").alias("attribution"))


def _order(features: Sequence[str], sample: int, seed: int) -> list[str]:
    import random

    order = list(features)
    random.Random(f"{seed}-{sample}").shuffle(order)
    return order


def mean_attributions(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def top_attributions(attributions: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The ``top`` strongest features of every row."""
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("attribution")), "feature")
    return attributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def model_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Tree importances or absolute coefficients of the last stage per source column, largest first.

    A category's levels are summed; a column that the preprocessing dropped has none.
    """
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    found = dict.fromkeys(features, 0.0)
    for slot, value in zip(model.stages[0].slots(), values.toArray(), strict=True):
        if slot not in found:
            raise ValueError(f"the model has the source column {slot!r}, which is not named")
        found[slot] += abs(float(value))
    return spark.createDataFrame(list(found.items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def model_attributions(model: PipelineModel, df: DataFrame, key: str) -> tuple[DataFrame, float]:
    """((key, feature, attribution), base) of a fitted tree pipeline; base + a row's attributions is its score.

    The score is a probability for a tree or a forest and a margin for boosted trees.
    """
    ensemble = ensemble_of(model.stages[-1], df.sparkSession)
    vectors = model.stages[0].transform(df)
    return tree_attributions(vectors, ensemble, model.stages[0].slots(), key), ensemble.base()


def sensitivity_sweep(
    df: DataFrame, model: PipelineModel, features: Sequence[str], key: str, span: float = 0.1, steps: int = 20
) -> DataFrame:
    """(key, feature, factor, score): each feature of each row moved within +-span."""
    factors = [1 - span + 2 * span * i / (steps - 1) for i in range(steps)]
    moves = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.lit(f).alias("factor")) for c in features for f in factors]
    )
    copies = df.withColumn("m", F.explode(moves)).select("*", "m.feature", "m.factor").drop("m")
    moved = copies.withColumns(
        {c: F.when(F.col("feature") == c, F.col(c) * F.col("factor")).otherwise(F.col(c)) for c in features}
    )
    return with_score(model.transform(moved)).select(key, "feature", "factor", "score")


def counterfactuals(
    df: DataFrame, model: PipelineModel, modifiable: Sequence[str], key: str, target: float, k: int = 3,
    grid: int = 5, rounds: int = 2,
) -> DataFrame:
    """k changes per row that bring the score close to ``target``, of different features where that is possible.

    A round moves one modifiable feature of every kept state to grid values inside the data range widened by 10 %.
    k states per row go on: first the best of each set of changed features, then the second best of each; the row as it
    is comes last. Nearness of the score decides, then the size of the change in standard deviations.
    """
    ranges = df.agg(
        *[F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.stddev_samp(c).alias("sd")).alias(c) for c in modifiable]
    ).first()
    options: list[Column] = [F.struct(F.lit("").alias("feature"), F.lit(0.0).alias("to"))]
    for c in modifiable:
        low, high = ranges[c].low, ranges[c].high
        widen = 0.1 * (high - low)
        for i in range(grid):
            value = low - widen + (high - low + 2 * widen) * i / (grid - 1)
            options.append(F.struct(F.lit(c).alias("feature"), F.lit(float(value)).alias("to")))
    state = df.withColumns({f"_from_{c}": F.col(c) for c in modifiable})
    best_before = None
    for _ in range(rounds):
        # dealt by key before rows are multiplied: the steps below work on rows of one key and move nothing any more
        tried = spread(state, key).withColumn("o", F.explode(F.array(*options)))
        moved = tried.withColumns(
            {c: F.when(F.col("o.feature") == c, F.col("o.to")).otherwise(F.col(c)) for c in modifiable}
        ).dropDuplicates([key, *modifiable])
        size = F.sqrt(
            sum(
                (F.pow((F.col(c) - F.col(f"_from_{c}")) / F.lit(ranges[c].sd or 1.0), 2) for c in modifiable),
                F.lit(0.0),
            )
        )
        changed = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"_from_{c}")), F.lit(c)) for c in modifiable])
        scored = with_score(model.transform(moved)).withColumns(
            {"distance": F.abs(F.col("score") - F.lit(target)), "change": size, "changed": changed}
        ).select(*df.columns, *[f"_from_{c}" for c in modifiable], "score", "distance", "change", "changed")
        # a row has a fixed, small number of candidates: the best of every set of changed features, then the second best
        nearest = [F.round("distance", 6), F.round("change", 6), *modifiable]
        ranked = scored.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "changed").orderBy(*nearest)))
        order = Window.partitionBy(key).orderBy(F.col("changed") == "", "_nth", *nearest)
        best = ranked.withColumn("solution", F.row_number().over(order)).filter(F.col("solution") <= k)
        best = cut_lineage(best)
        if best_before is not None:
            drop_table(best_before)
        best_before = best
        state = best.drop("score", "distance", "change", "changed", "solution", "_nth")
    return best.select(key, "solution", "changed", *modifiable, "score", "distance", "change")
