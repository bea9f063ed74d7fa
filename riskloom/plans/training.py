"""Cross-validation, search, stacking, calibration, learning curves, and the whole experiment.

Folds are columns of one table. Models and folds run as driver threads that submit Spark jobs; all
predictions of one call are measured together by exact rank statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_order
from riskloom.operators.compare import pairwise_model_tests
from riskloom.operators.evaluate import rank_measures, ranked_scores, threshold_metrics
from riskloom.operators.split import stratified_folds
from riskloom.plans.boosting import BoostedTrees
from riskloom.plans.models import (
    classifier,
    default_balancing,
    hashed_share,
    keeps_nodes,
    model_input,
    parameter_grid,
    predict,
    sampled_grid,
    with_score,
)
from riskloom.plans.search import FOREST_SPACE, ParzenSearch
from riskloom.plans.stages import FIT_ROWS, Balanced, Preprocessor
from riskloom.session import cut_lineage, drop_table

PARALLEL_FITS = 4
PARALLEL_FOLDS = 2  # one fold is prepared while the fits of another run
# Fits that run side by side keep at most so many bytes of rows in Spark's memory (one fit may always run)
KEPT_BYTES = 4 << 30


@dataclass
class ModelSpec:
    """A catalogue model with its columns, parameters and balancing of the training part."""

    name: str
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    params: dict = field(default_factory=dict)
    balancing: str = "none"
    scale: bool = True
    label: str | None = None
    imputer: str = "simple"
    selection: bool = False

    @property
    def title(self) -> str:
        return self.label or self.name


def preprocessor(spec: ModelSpec, key: str, seed: int = 42) -> Preprocessor:
    return Preprocessor(
        numeric=list(spec.numeric), categorical=list(spec.categorical), keyCol=key, scale=spec.scale,
        imputer=spec.imputer, selection=spec.selection, seed=seed,
    )


def balanced(spec: ModelSpec, key: str, seed: int = 42, **params) -> Balanced:
    """The spec's learner (parameters may be overridden), fitted on rows balanced after preprocessing."""
    strategy = spec.balancing if spec.balancing != "none" else default_balancing(spec.name)
    learner = classifier(spec.name, seed, key, **(dict(spec.params) | params))
    return Balanced(learner, strategy=strategy, keyCol=key, seed=seed)


def fit_model(train: DataFrame, spec: ModelSpec, key: str, seed: int = 42) -> PipelineModel:
    """Preprocess, balance, fit: all of it learns from the training rows only, and new rows are never resampled."""
    return Pipeline(stages=[preprocessor(spec, key, seed), balanced(spec, key, seed)]).fit(train)


def _run_all(jobs: Sequence[Callable], threads: int = PARALLEL_FITS) -> list:
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def side_by_side(rows: int, forests: Iterable[Mapping]) -> int:
    """How many fits over ``rows`` rows run at once: a learner keeps about 100 bytes a row, and a count per tree of a forest.

    A deep forest also keeps a row's node in every tree, of this level and of the one before.
    """
    kept = max((int(p.get("numTrees", 20)) * (12 if keeps_nodes(p) else 4) for p in forests), default=0)
    return max(1, min(PARALLEL_FITS, KEPT_BYTES // max(1, rows * (100 + kept))))


def with_folds(df: DataFrame, key: str, k: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Fold columns, written once: every fit reads the same assignment."""
    return cut_lineage(stratified_folds(df, "label", key, k, repeats, seed), FIT_ROWS)


def fold_predictions(
    folded: DataFrame, specs: Sequence[ModelSpec], key: str, k: int, repeats: int = 1, seed: int = 42,
    train_scores: bool = False, first: int = 0,
) -> DataFrame:
    """(model, run, part, key, label, score): validation rows of every fold, optionally training rows.

    Specs that prepare their rows alike share each fold's preprocessing and its written training rows. ``first`` is the
    repeat to begin with.
    """
    threads = side_by_side(folded.count() * (k - 1) // k, [s.params for s in specs if s.name.removesuffix("_balanced") == "rf"])
    alike: dict[tuple, list[int]] = {}
    for i, s in enumerate(specs):
        alike.setdefault((tuple(s.numeric), tuple(s.categorical), s.scale, s.imputer, s.selection), []).append(i)

    def job(i: int, r: int, f: int, model: PipelineModel | None = None) -> DataFrame:
        spec, held = specs[i], F.col(f"fold_{r}") == f
        model = model or fit_model(folded.filter(~held), spec, key, seed)
        scored = with_score(model.transform(folded if train_scores else folded.filter(held)))
        part = F.when(held, "validation").otherwise("train")
        return scored.select(
            F.lit(spec.title).alias("model"), F.lit(r * k + f).alias("run"), part.alias("part"),
            key, "label", "score",
        )

    def fit_alike(same: list[int], r: int, f: int) -> list[DataFrame]:
        train = folded.filter(F.col(f"fold_{r}") != f)
        ready = preprocessor(specs[same[0]], key, seed).fit(train)
        rows = cut_lineage(ready.transform(train).select(key, "label", "features"), FIT_ROWS)
        models = [m.result() for m in [fits.submit(balanced(specs[i], key, seed).fit, rows) for i in same]]
        drop_table(rows)
        return [job(i, r, f, PipelineModel([ready, m])) for i, m in zip(same, models)]

    places = [(r, f) for r in range(first, first + repeats) for f in range(k)]
    with ThreadPoolExecutor(threads) as fits, ThreadPoolExecutor(PARALLEL_FOLDS) as folds:
        lone = {(same[0], r, f): fits.submit(job, same[0], r, f) for same in alike.values() if len(same) == 1 for r, f in places}
        met = {(tuple(same), r, f): folds.submit(fit_alike, same, r, f) for same in alike.values() if len(same) > 1 for r, f in places}
        scored = {at: found.result() for at, found in lone.items()}
        for (same, r, f), found in met.items():
            scored |= zip([(i, r, f) for i in same], found.result())
    in_order = [scored[i, r, f] for i in range(len(specs)) for r, f in places]
    return cut_lineage(reduce(DataFrame.unionByName, in_order), FIT_ROWS)


def run_scores(predictions: DataFrame) -> DataFrame:
    """AUROC and average precision per (model, run, part), all runs in one pass."""
    by = ["model", "run", "part"]
    return rank_measures(ranked_scores(predictions, "label", "score", by), by)


def cross_validate(
    df: DataFrame, specs: Sequence[ModelSpec], key: str, k: int = 5, repeats: int = 6, seed: int = 42
) -> DataFrame:
    """(model, run, value): validation AUROC of each fold of each repeat.

    A repeat scores every row once per spec; its predictions are measured and deleted before the next one begins.
    """
    folded = with_folds(df, key, k, repeats, seed)
    found: list[tuple] = []
    for r in range(repeats):
        predictions = fold_predictions(folded, specs, key, k, 1, seed, first=r)
        found += run_scores(predictions).select("model", "run", F.col("auroc").alias("value")).collect()
        drop_table(predictions)
    return df.sparkSession.createDataFrame(found, "model string, run int, value double")


def fit_regression(train: DataFrame, spec: ModelSpec, key: str, seed: int = 42) -> PipelineModel:
    """Preprocessing and linear regression (``linreg``) or boosted trees on squares (``xgb``) for a numeric label."""
    if spec.name == "linreg":
        learner = LinearRegression(featuresCol="features", labelCol="label", **spec.params)
    elif spec.name == "xgb":
        learner = BoostedTrees(objective="squared", seed=seed, **spec.params)
    else:
        raise ValueError(f"{spec.name!r} does not predict numbers")
    return Pipeline(stages=[preprocessor(spec, key, seed), learner]).fit(train)


def cross_validate_regression(
    df: DataFrame, specs: Sequence[ModelSpec], key: str, k: int = 5, repeats: int = 1, seed: int = 42
) -> DataFrame:
    """(model, run, rmse, mae, r2) of held-out rows; folds follow the hash of the key."""
    rows = cut_lineage(df)

    def job(spec: ModelSpec, r: int, f: int) -> DataFrame:
        held = F.pmod(hash_order(key, f"{seed}-{r}"), F.lit(k)) == f
        scored = fit_regression(rows.filter(~held), spec, key, seed).transform(rows.filter(held))
        return scored.select(F.lit(spec.title).alias("model"), F.lit(r * k + f).alias("run"), "label", "prediction")

    jobs = [(lambda s=s, r=r, f=f: job(s, r, f)) for s in specs for r in range(repeats) for f in range(k)]
    scored = cut_lineage(reduce(DataFrame.unionByName, _run_all(jobs)))
    off = F.col("label") - F.col("prediction")
    return scored.groupBy("model", "run").agg(
        F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), (1 - F.avg(off * off) / F.var_pop("label")).alias("r2")
    )


def summarise_runs(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.count("value").alias("n_runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def nested_cross_validate(
    df: DataFrame, spec: ModelSpec, key: str, outer: int = 3, inner: int = 3, draws: int = 10, seed: int = 42
) -> DataFrame:
    """Outer AUROC with parameters chosen by random search on each outer training part.

    The spread over outer folds is the population standard deviation.
    """
    folded = with_folds(df, key, outer, 1, seed)

    def job(f: int) -> DataFrame:
        train = folded.filter(F.col("fold_0") != f).drop("fold_0")
        best, _ = random_search(train, spec, key, draws, inner, seed)
        scored = with_score(best.transform(folded.filter(F.col("fold_0") == f)))
        return scored.select(F.lit(spec.title).alias("model"), F.lit(f).alias("run"), F.lit("validation").alias("part"), "label", "score")

    predictions = cut_lineage(reduce(DataFrame.unionByName, [job(f) for f in range(outer)]))
    return run_scores(predictions).groupBy("model").agg(
        F.count("auroc").alias("n_folds"), F.avg("auroc").alias("mean"), F.stddev_pop("auroc").alias("std")
    )


def prepared_fold(folded: DataFrame, spec: ModelSpec, key: str, f: int, seed: int = 42) -> tuple[DataFrame, DataFrame, str]:
    """Training rows (preprocessed, balanced) and held-out rows of one fold, written, and how a learner is to be fitted."""
    train, held = folded.filter(F.col("fold_0") != f), folded.filter(F.col("fold_0") == f)
    ready = preprocessor(spec, key, seed).fit(train)
    plain = balanced(spec, key, seed)
    rows = cut_lineage(plain.resampled(ready.transform(train).select(key, "label", "features")), FIT_ROWS)
    seen = cut_lineage(ready.transform(held).select(key, "label", "features"), FIT_ROWS)
    return rows, seen, "class_weight" if plain.getOrDefault("strategy") == "class_weight" else "none"


def candidate_scores(
    prepared: Mapping[int, tuple[DataFrame, DataFrame, str]], spec: ModelSpec, key: str, points: Sequence[dict], seed: int = 42
) -> DataFrame:
    """(model, run, auroc): every point on every prepared fold; ``model`` is the place of the point.

    A fold is preprocessed and balanced once for all points, with the spec's own parameters and balancing.
    """

    def job(i: int, point: dict, f: int) -> DataFrame:
        rows, seen, kind = prepared[f]
        learner = balanced(spec, key, seed, **point)
        model = learner.copy({learner.strategy: kind}).fit(rows)
        return with_score(model.transform(seen)).select(
            F.lit(str(i)).alias("model"), F.lit(f).alias("run"), F.lit("validation").alias("part"), "label", "score"
        )

    jobs = [(lambda i=i, p=p, f=f: job(i, p, f)) for f in prepared for i, p in enumerate(points)]
    forests = [dict(spec.params) | p for p in points] if spec.name.removesuffix("_balanced") == "rf" else []
    threads = side_by_side(max(rows.count() for rows, _, _ in prepared.values()), forests)
    scored = cut_lineage(reduce(DataFrame.unionByName, _run_all(jobs, threads)), FIT_ROWS)
    return run_scores(scored).select(F.col("model").cast("int").alias("model"), "run", "auroc")


def point_means(df: DataFrame, spec: ModelSpec, key: str, points: Sequence[dict], k: int, seed: int) -> list[float]:
    """Mean validation AUROC of every point."""
    folded = with_folds(df, key, k, 1, seed)
    prepared = dict(enumerate(_run_all([lambda f=f: prepared_fold(folded, spec, key, f, seed) for f in range(k)])))
    scores = candidate_scores(prepared, spec, key, points, seed)
    means = {r["model"]: r["auroc"] for r in scores.groupBy("model").agg(F.avg("auroc").alias("auroc")).collect()}
    return [float(means.get(i) or 0.0) for i in range(len(points))]


def shown(point: dict) -> str:
    return ", ".join(f"{n}={v}" for n, v in sorted(point.items()))


def random_search(
    df: DataFrame, spec: ModelSpec, key: str, draws: int = 10, k: int = 3, seed: int = 42,
    points: Sequence[dict] | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Best model over sampled grid points (or the given points), refitted, and the (params, auroc) table.

    Points override the spec's parameters; its other parameters and its balancing hold for every candidate.
    """
    points = list(points or sampled_grid(spec.name, draws, seed))
    means = point_means(df, spec, key, points, k, seed)
    best = min(range(len(points)), key=lambda i: (-means[i], i))
    model = fit_model(df, replace(spec, params=dict(spec.params) | points[best]), key, seed)
    rows = [(shown(p), m) for p, m in zip(points, means)]
    return model, df.sparkSession.createDataFrame(rows, "params string, auroc double")


def grid_search(df: DataFrame, spec: ModelSpec, key: str, k: int = 3, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """``random_search`` over every point of the entry's grid."""
    return random_search(df, spec, key, k=k, seed=seed, points=parameter_grid(spec.name))


def density_ratio_search(
    df: DataFrame, spec: ModelSpec, key: str, trials: int = 50, k: int = 5, seed: int = 42,
    space: Mapping[str, Sequence] | None = None, startup: int = 10,
) -> tuple[PipelineModel, DataFrame]:
    """Model search by density ratios with median stops (see ``search.ParzenSearch``) over ``space``.

    Returns the refitted best model and the history (trial, params, folds, auroc, stopped). A trial is measured fold by
    fold and is stopped when its running mean falls below the median of earlier trials at the same fold. The space's
    ``balancing`` values choose the balancing; other names are parameters of the learner.
    """
    search = ParzenSearch(FOREST_SPACE if space is None else space, seed, startup)
    folded = with_folds(df, key, k, 1, seed)
    prepared: dict[tuple[str, int], tuple[DataFrame, DataFrame, str]] = {}  # a fold is written once per balancing
    history = []
    for trial in range(trials):
        point = search.propose()
        chosen = candidate(spec, point)
        found: list[float] = []
        for f in range(k):
            place = (chosen.balancing, f)
            if place not in prepared:
                prepared[place] = prepared_fold(folded, chosen, key, f, seed)
            found.append(candidate_scores({f: prepared[place]}, chosen, key, [{}], seed).first()["auroc"] or 0.0)
            if f + 1 < k and search.stops(found):
                break
        search.record(point, found)
        history.append((trial, shown(point), len(found), sum(found) / len(found), len(found) < k))
    model = fit_model(df, candidate(spec, search.best(k)), key, seed)
    return model, df.sparkSession.createDataFrame(history, "trial int, params string, folds int, auroc double, stopped boolean")


def candidate(spec: ModelSpec, point: dict) -> ModelSpec:
    params = {n: v for n, v in point.items() if n != "balancing"}
    return replace(spec, params=dict(spec.params) | params, balancing=point.get("balancing", spec.balancing))


def halving_search(
    df: DataFrame, spec: ModelSpec, key: str, draws: int = 8, rounds: int = 3, k: int = 3, seed: int = 42
) -> DataFrame:
    """Successive halving: every round doubles the rows and keeps the better half of the candidates."""
    points = sampled_grid(spec.name, draws, seed)
    history = []
    for r in range(rounds):
        share = 1.0 / 2 ** (rounds - 1 - r)
        part = hashed_share(df, key, share, f"{seed}-halving") if share < 1 else df
        scores = point_means(part, spec, key, points, k, seed)
        history += [(r, share, shown(p), a) for p, a in zip(points, scores)]
        ranked = sorted(zip(scores, range(len(points))), key=lambda t: (-t[0], t[1]))
        points = [points[i] for _, i in ranked[: max(1, len(points) // 2)]]
    return df.sparkSession.createDataFrame(history, "round int, share double, params string, auroc double")


def platt_calibration(
    df: DataFrame, spec: ModelSpec, key: str, k: int = 2, seed: int = 42
) -> tuple[PipelineModel, PipelineModel]:
    """Base model on all rows, and a one-feature logistic model fitted on out-of-fold scores."""
    folded = with_folds(df, key, k, 1, seed)
    scores = fold_predictions(folded, [spec], key, k, 1, seed)
    sigmoid = Pipeline(
        stages=[
            VectorAssembler(inputCols=["score"], outputCol="score_vector"),
            LogisticRegression(featuresCol="score_vector", labelCol="label", maxIter=50),
        ]
    ).fit(scores.select("score", "label"))
    return fit_model(df, spec, key, seed), sigmoid


def calibrated(base: PipelineModel, sigmoid: PipelineModel, df: DataFrame) -> DataFrame:
    raw = with_score(base.transform(df)).drop("rawPrediction", "probability", "prediction")
    return with_score(sigmoid.transform(raw), "calibrated")


def stack(
    df: DataFrame, specs: Sequence[ModelSpec], key: str, k: int = 3, seed: int = 42
) -> tuple[dict[str, PipelineModel], PipelineModel, DataFrame]:
    """Base models refitted on all rows, a logistic meta model on out-of-fold scores, and its weights."""
    folded = with_folds(df, key, k, 1, seed)
    scores = fold_predictions(folded, specs, key, k, 1, seed)
    titles = [s.title for s in specs]
    wide = scores.groupBy(key, "label").pivot("model", titles).agg(F.first("score"))
    meta = Pipeline(
        stages=[
            VectorAssembler(inputCols=titles, outputCol="base_scores"),
            LogisticRegression(featuresCol="base_scores", labelCol="label", maxIter=50),
        ]
    ).fit(wide)
    weights = [(t, float(w)) for t, w in zip(titles, meta.stages[-1].coefficients)]
    table = df.sparkSession.createDataFrame(weights, "model string, weight double")
    return {s.title: fit_model(df, s, key, seed) for s in specs}, meta, table


def stacked_scores(bases: dict[str, PipelineModel], meta: PipelineModel, df: DataFrame) -> DataFrame:
    """Score of the meta model; base scores are columns of the same rows, so nothing is joined."""
    columns = df.columns
    for title, model in bases.items():
        df = with_score(model.transform(df), title).select(*columns, title)
        columns = df.columns
    return with_score(meta.transform(df))


def learning_curve(
    df: DataFrame, spec: ModelSpec, key: str, shares: Sequence[float] = tuple(i / 10 for i in range(1, 11)),
    k: int = 5, seed: int = 42,
) -> DataFrame:
    """(share, train_mean, train_std, validation_mean, validation_std) over nested sub-samples."""
    parts = []
    for share in shares:
        rows = hashed_share(df, key, share, f"{seed}-curve") if share < 1 else df
        folded = with_folds(rows, key, k, 1, seed)
        parts.append(
            fold_predictions(folded, [spec], key, k, 1, seed, train_scores=True).withColumn(
                "model", F.lit(str(share))
            )
        )
    measured = run_scores(reduce(DataFrame.unionByName, parts))
    pick = lambda part: F.when(F.col("part") == part, F.col("auroc"))
    return measured.groupBy(F.col("model").cast("double").alias("share")).agg(
        F.avg(pick("train")).alias("train_mean"),
        F.stddev_pop(pick("train")).alias("train_std"),
        F.avg(pick("validation")).alias("validation_mean"),
        F.stddev_pop(pick("validation")).alias("validation_std"),
    )


def diagnose_curve(curve: DataFrame) -> DataFrame:
    """One row with the gap, convergence and diagnosis flags of a learning curve (one row per share)."""
    ordered = curve.agg(
        F.sort_array(F.collect_list(F.struct("share", "train_mean", "validation_mean"))).alias("c")
    )
    last = F.element_at("c", -1)
    first = F.element_at("c", 1)
    recent = F.transform(F.slice("c", -3, 3), lambda x: x["validation_mean"])
    mean = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / 3
    spread = F.sqrt(F.aggregate(recent, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 3)
    row = ordered.select(
        last["train_mean"].alias("final_train"),
        last["validation_mean"].alias("final_validation"),
        F.abs(last["train_mean"] - last["validation_mean"]).alias("gap"),
        (last["train_mean"] > first["train_mean"]).alias("train_improving"),
        (last["validation_mean"] > first["validation_mean"]).alias("validation_improving"),
        F.when(F.size("c") >= 3, spread < 0.01).otherwise(F.lit(False)).alias("converged"),
    )
    return row.withColumns(
        {
            "underfitting": (F.col("final_train") < 0.75) & (F.col("final_validation") < 0.75),
            "overfitting": F.col("gap") > 0.1,
            "not_converged": ~F.col("converged") & F.col("validation_improving"),
            "good_fit": (F.col("gap") < 0.05) & (F.col("final_validation") > 0.8),
        }
    )


def balancer_grid(
    df: DataFrame, specs: Sequence[ModelSpec], balancers: Sequence[str], key: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """(model, balancing, auroc, auprc, accuracy, f1, recall): every balancer with every model."""
    folded = with_folds(df, key, k, 1, seed)
    variants = [
        ModelSpec(s.name, s.numeric, s.categorical, s.params, b, s.scale, f"{s.title}|{b}")
        for s in specs
        for b in balancers
    ]
    predictions = fold_predictions(folded, variants, key, k, 1, seed)
    ranks = run_scores(predictions)
    rates = threshold_metrics(predictions, "label", "score", 0.5, ["model", "run"])
    names = ["auroc", "auprc", "accuracy", "f1", "recall"]
    joined = ranks.join(rates, ["model", "run"]).groupBy("model").agg(*[F.avg(c).alias(c) for c in names])
    parts = F.split("model", r"\|")
    return joined.select(parts[0].alias("model"), parts[1].alias("balancing"), *names)


def forward_selection(
    df: DataFrame, features: Sequence[str], key: str, name: str = "logreg", limit: int = 25, k: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(step, feature, auroc): add the feature that raises mean validation AUROC most; stop at no gain."""
    folded = with_folds(df, key, k, 1, seed)
    chosen: list[str] = []
    steps: list[tuple[int, str, float]] = []
    best = 0.0
    while len(chosen) < min(limit, len(features)):
        specs = [
            ModelSpec(name, [*chosen, f], label=f) for f in features if f not in chosen
        ]
        scores = run_scores(fold_predictions(folded, specs, key, k, 1, seed))
        top = scores.groupBy("model").agg(F.avg("auroc").alias("auroc")).orderBy(F.desc("auroc"), "model").first()
        if top.auroc <= best:
            break
        chosen.append(top.model)
        best = top.auroc
        steps.append((len(chosen), top.model, best))
    return df.sparkSession.createDataFrame(steps, "step int, feature string, auroc double")


def prefix_sweep(
    df: DataFrame, ordered: Sequence[str], sizes: Sequence[int], names: Sequence[str], key: str, k: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(n_features, model, mean, std): the first k features of a ranking, for several models."""
    folded = with_folds(df, key, k, 1, seed)
    specs = [ModelSpec(n, list(ordered[:size]), label=f"{n}|{size}") for n in names for size in sizes]
    scores = run_scores(fold_predictions(folded, specs, key, k, 1, seed))
    parts = F.split("model", r"\|")
    return (
        scores.groupBy(parts[0].alias("model"), parts[1].cast("int").alias("n_features"))
        .agg(F.avg("auroc").alias("mean"), F.stddev_samp("auroc").alias("std"))
    )


def importance_selection(
    df: DataFrame, features: Sequence[str], key: str, seed: int = 42, categorical: Sequence[str] = ()
) -> DataFrame:
    """(feature, importance, kept): forest importance at least the median; a category's levels are summed."""
    model = fit_model(df, ModelSpec("rf", list(features), list(categorical), scale=False), key, seed)
    found = dict.fromkeys([*features, *categorical], 0.0)  # dropped columns have none
    for slot, value in zip(model.stages[0].slots(), model.stages[-1].featureImportances.toArray(), strict=True):
        found[slot] += float(value)
    ordered = sorted(found.values())
    middle = len(ordered) // 2
    median = ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) / 2
    rows = [(f, v, bool(v >= median)) for f, v in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, kept boolean")


def run_experiment(
    df: DataFrame, target: str, key: str, specs: Sequence[ModelSpec], k: int = 5, repeats: int = 2,
    seed: int = 42, save_to: str | None = None,
) -> dict[str, object]:
    """Cross-validate, test all pairs, refit the best by mean, and describe it in one metadata row."""
    numeric = sorted({c for s in specs for c in s.numeric})
    categorical = sorted({c for s in specs for c in s.categorical})
    rows = cut_lineage(model_input(df, target, key, numeric, categorical), FIT_ROWS)
    scores = cut_lineage(cross_validate(rows, specs, key, k, repeats, seed))
    summary = summarise_runs(scores)
    best = summary.orderBy(F.desc("mean"), "model").first()
    spec = next(s for s in specs if s.title == best.model)
    model = fit_model(rows, spec, key, seed)
    metadata = rows.agg(
        F.lit(best.model).alias("model"), F.lit(best["mean"]).alias("cv_mean"), F.lit(best["std"]).alias("cv_std"),
        F.count("*").alias("n_rows"), F.avg("label").alias("positive_share"),
        F.lit(",".join([*spec.numeric, *spec.categorical])).alias("features"),
    )
    if save_to:
        model.write().overwrite().save(f"{save_to}/model")
        metadata.write.mode("overwrite").parquet(f"{save_to}/metadata")
    return {
        "scores": scores, "summary": summary, "tests": pairwise_model_tests(scores), "model": model,
        "metadata": metadata,
    }


def check_features(metadata: DataFrame, df: DataFrame) -> None:
    """Raise when a table to be scored lacks a feature of the saved model."""
    wanted = metadata.first().features.split(",")
    lacking = [c for c in wanted if c not in df.columns]
    if lacking:
        raise ValueError(f"missing features: {lacking}")


def load_and_predict(folder: str, df: DataFrame) -> DataFrame:
    metadata = df.sparkSession.read.parquet(f"{folder}/metadata")
    check_features(metadata, df)
    return predict(PipelineModel.load(f"{folder}/model"), df, metadata.first().model)
