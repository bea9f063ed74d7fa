"""Neighbour-based balancing: synthetic minority rows and neighbour-based removal.

Neighbours come from the exact kNN join; every random choice is a hash of keys and the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_order, hash_uniform
from riskloom.operators.knn import knn_join
from riskloom.operators.margin import FourierMap, fit_margin, margin_column
from riskloom.operators.prefix import has_whole_number, with_key_numbers
from riskloom.operators.split import class_counts, first_rows
from riskloom.session import cut_lineage

_FILE_ROWS = 1 << 16  # rows in a file of the table that the margin's passes read


def _classes(df: DataFrame, target: str) -> tuple[object, int, int]:
    """Minority class, its size, and the size of the largest class."""
    counts = class_counts(df, target)
    minority = min(counts, key=lambda v: (counts[v], str(v)))
    return minority, counts[minority], max(counts.values())


def _copies(seeds: DataFrame, needed: int, seed: int, weight: str | None = None) -> DataFrame:
    """Seed rows with how often each is used, ``copies``, summing to exactly ``needed``.

    Without a weight all seeds are used equally often; the first in hash order once more.
    """
    if weight is None:
        n = seeds.count()
        if n == 0 or needed <= 0:
            return seeds.withColumn("copies", F.lit(0)).limit(0)
        extra = first_rows(seeds, [hash_order("key", seed)], "key", {None: [needed % n]})[0][(None, needed % n)]
        return seeds.withColumn("copies", F.lit(needed // n) + F.when(extra, 1).otherwise(F.lit(0)))
    total = seeds.agg(F.sum(weight)).first()[0]
    if not total:
        return seeds.withColumn("copies", F.lit(0)).limit(0)
    share = F.col(weight) / F.lit(float(total)) * F.lit(needed)
    placed = seeds.withColumn("copies", F.floor(share).cast("int"))
    placed = cut_lineage(placed)
    missing = needed - (placed.agg(F.sum("copies")).first()[0] or 0)
    rows = placed.filter(F.col(weight) > 0)
    extra = first_rows(rows, [hash_order("key", seed)], "key", {None: [missing]})[0][(None, missing)]
    return rows.withColumn("copies", F.col("copies") + F.when(extra, 1).otherwise(F.lit(0)))


def _mix(
    seeds: DataFrame, near: DataFrame, rows: DataFrame, columns: Sequence[str], seed: int
) -> DataFrame:
    """One synthetic row per copy: x + u * (neighbour - x), neighbour and u from hashes."""
    copies = seeds.filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    neighbours = near.groupBy("key").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "neighbour"))), lambda s: s["neighbour"]
        ).alias("neighbours")
    )
    tag = F.concat_ws("/", F.col("key").cast("string"), F.col("copy").cast("string"))
    # rows meet rows: merged, as the size of a packed file says little about them
    picked = copies.select("key", "copy").join(neighbours.hint("merge"), "key").withColumn(
        "neighbour",
        F.element_at(
            "neighbours", (F.pmod(hash_order(tag, f"{seed}-n"), F.size("neighbours")) + 1).cast("int")
        ),
    ).withColumn("u", hash_uniform(tag, f"{seed}-u"))
    own = rows.select("key", *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    other = rows.select(
        F.col("key").alias("neighbour"), *[F.col(c).cast("double").alias(f"b_{c}") for c in columns]
    )
    joined = picked.join(own.hint("merge"), "key").join(other.hint("merge"), "neighbour")
    return joined.select(
        F.col("key").alias("parent"), "neighbour", "copy", "u",
        *[(F.col(f"a_{c}") + F.col("u") * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in columns],
    )


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("key", F.col(key).cast("long"))


def smote(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 5, seed: int = 42,
    seeds: DataFrame | None = None, weight: str | None = None,
) -> DataFrame:
    """Synthetic minority rows up to parity: (parent, neighbour, copy, u, columns, target).

    ``seeds`` limits the rows that spawn (default: all minority rows); ``weight`` spreads the rows.
    """
    minority, n_min, n_max = _classes(df, target)
    rows = _keyed(df.filter(F.col(target) == F.lit(minority)), key).dropna(subset=list(columns))
    seeds = rows if seeds is None else seeds
    planned = cut_lineage(_copies(seeds.select("key", *([weight] if weight else [])), n_max - n_min, seed, weight))
    near = knn_join(
        rows.join(planned.select("key"), "key", "left_semi"), rows, "key", columns, k, skip_self=True
    )
    made = _mix(planned, near, rows, columns, seed)
    return made.withColumn(target, F.lit(minority))


def smote_nc(
    df: DataFrame, target: str, key: str, columns: Sequence[str], categories: Sequence[str],
    k: int = 5, seed: int = 42,
) -> DataFrame:
    """SMOTE on the numbers; each category is the most frequent among the parent's neighbours.

    Distance adds, per differing category, the squared median of the minority standard deviations:
    categories enter the search as scaled 0/1 coordinates (each difference changes two of them).
    """
    minority, n_min, n_max = _classes(df, target)
    rows = _keyed(df.filter(F.col(target) == F.lit(minority)), key).dropna(subset=[*columns, *categories])
    spread = rows.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    ordered = sorted(spread[c] for c in columns)
    middle = len(ordered) // 2
    median = ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) / 2
    coordinates = list(columns)
    for c in categories:
        from riskloom.operators.encode import fit_one_hot

        for i, value in enumerate(fit_one_hot(rows, c)):
            name = f"_{c}_{i}"
            rows = rows.withColumn(
                name, F.when(F.col(c).cast("string") == value, F.lit(median / 2**0.5)).otherwise(F.lit(0.0))
            )
            coordinates.append(name)
    rows = cut_lineage(rows)
    planned = cut_lineage(_copies(rows.select("key"), n_max - n_min, seed))
    near = cut_lineage(knn_join(rows, rows, "key", coordinates, k, skip_self=True))
    made = _mix(planned, near, rows, columns, seed)
    values = rows.select(F.col("key").alias("neighbour"), *categories)
    votes = near.join(values, "neighbour").groupBy("key").agg(
        *[F.mode(c, True).alias(c) for c in categories]  # k values per parent, ties: smallest
    )
    return made.join(votes.withColumnRenamed("key", "parent"), "parent").withColumn(target, F.lit(minority))


def neighbour_mix(
    df: DataFrame, queries: DataFrame, target: str, key: str, columns: Sequence[str], k: int
) -> DataFrame:
    """(key, n, others): neighbours of each query row over all classes, and how many differ in class."""
    rows = _keyed(df, key).dropna(subset=list(columns))
    asked = _keyed(queries, key)
    near = knn_join(asked, rows, "key", columns, k, skip_self=True)
    own = rows.select("key", F.col(target).alias("y"))
    other = rows.select(F.col("key").alias("neighbour"), F.col(target).alias("ny"))
    return (
        near.join(own.hint("merge"), "key").join(other.hint("merge"), "neighbour").groupBy("key")
        .agg(F.count("*").alias("n"), F.count_if(F.col("y") != F.col("ny")).alias("others"))
    )


def adasyn(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """More synthetic rows where more of a minority row's k neighbours are of another class."""
    minority, _, _ = _classes(df, target)
    mix = neighbour_mix(df, df.filter(F.col(target) == F.lit(minority)), target, key, columns, k)
    weighted = cut_lineage(mix.select("key", (F.col("others") / F.col("n")).alias("hardness")))
    return smote(df, target, key, columns, k, seed, seeds=weighted, weight="hardness")


def borderline_smote(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 5, m: int = 10, seed: int = 42
) -> DataFrame:
    """Seeds are minority rows with at least half, but not all, of m neighbours of another class."""
    minority, _, _ = _classes(df, target)
    mix = neighbour_mix(df, df.filter(F.col(target) == F.lit(minority)), target, key, columns, m)
    seeds = mix.filter((F.col("others") * 2 >= F.col("n")) & (F.col("others") < F.col("n")))
    return smote(df, target, key, columns, k, seed, seeds=cut_lineage(seeds.select("key")))


def margin_seeds(
    df: DataFrame, target: str, key: str, columns: Sequence[str], features: int = 256, m: int = 10, seed: int = 42
) -> DataFrame:
    """``key`` of the minority rows that hold up the margin of a support vector classifier with a Gaussian kernel.

    The kernel's width is the variance over all cells, as in the usual "scale" setting; classes weigh the same. Rows
    whose ``m`` neighbours are all of another class are noise and no seeds. Rows with gaps take no part.
    """
    minority, _, _ = _classes(df, target)
    rows = _keyed(df, key).dropna(subset=list(columns))
    cells = rows.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("x"))
    variance = cells.agg(F.var_pop("x")).first()[0] or 0.0
    fourier, names = FourierMap.drawn(len(columns), variance, features, seed), [f"_x{i}" for i in range(len(columns))]
    labelled = cut_lineage(rows.select(
        "key", (F.col(target) == F.lit(minority)).cast("double").alias("_label"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, names)]
    ), _FILE_ROWS)
    n = {r[0]: r[1] for r in labelled.groupBy("_label").count().collect()}
    if not n.get(0.0) or not n.get(1.0):
        return rows.filter(F.col(target) == F.lit(minority)).select("key")
    if None in n:
        raise ValueError(f"rows without {target}")
    weighted = labelled.withColumn("_w", F.when(F.col("_label") == 1, n[0.0] / n[1.0]).otherwise(F.lit(1.0)))
    weights, shift = fit_margin(weighted, names, fourier, 1.0 / (2 * n[0.0]))
    held = labelled.filter("_label = 1").filter(margin_column(names, fourier, weights, shift) <= 1).select("key")
    mix = neighbour_mix(df, df.filter(F.col(target) == F.lit(minority)), target, key, columns, m)
    return held.join(mix.filter("others < n"), "key", "left_semi")


def svm_smote(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Seeds are the minority rows of ``margin_seeds``."""
    return smote(df, target, key, columns, k, seed, seeds=cut_lineage(margin_seeds(df, target, key, columns, seed=seed)))


def tomek_links(df: DataFrame, target: str, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, neighbour) pairs of different class that are each other's nearest neighbour."""
    rows = _keyed(df, key).dropna(subset=list(columns))
    near = cut_lineage(knn_join(rows, rows, "key", columns, 1, skip_self=True).select("key", "neighbour"))
    back = near.select(F.col("key").alias("neighbour"), F.col("neighbour").alias("key"))
    y = rows.select("key", F.col(target).alias("y"))
    ny = rows.select(F.col("key").alias("neighbour"), F.col(target).alias("ny"))
    mutual = near.join(back.hint("merge"), ["key", "neighbour"], "left_semi")
    return mutual.join(y.hint("merge"), "key").join(ny.hint("merge"), "neighbour").filter("y <> ny").select("key", "neighbour")


def without_tomek_links(df: DataFrame, target: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Drop the majority side of every Tomek link."""
    minority, _, _ = _classes(df, target)
    linked = tomek_links(df, target, key, columns).select(F.col("key").alias("_k"))
    losers = _keyed(df, key).filter(F.col(target) != F.lit(minority)).join(linked, F.col("key") == F.col("_k"), "left_semi")
    return df.join(losers.select(key), key, "left_anti")


def edited_neighbours(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 3
) -> DataFrame:
    """Drop majority rows unless all k neighbours share their class."""
    minority, _, _ = _classes(df, target)
    mix = neighbour_mix(df, df.filter(F.col(target) != F.lit(minority)), target, key, columns, k)
    losers = mix.filter("others > 0").select(F.col("key").alias("_k"))
    return df.join(losers, df[key].cast("long") == F.col("_k"), "left_anti")


def with_synthetic(
    df: DataFrame, made: DataFrame, target: str, key: str, columns: Sequence[str], seed: int = 42,
    categories: Sequence[str] = (),
) -> DataFrame:
    """Real and synthetic rows in one table; synthetic keys are negative hashes of their origin.

    Every real row stays, also one with gaps. A synthetic row that brings no category of its own has its parent's.
    """
    own = [c for c in categories if c in made.columns]
    lent = [c for c in categories if c not in made.columns]
    if lent:
        parents = df.select(F.col(key).cast("long").alias("parent"), *lent)
        made = made.join(parents, "parent")
    fresh = made.select(
        (-hash_order(F.concat_ws("/", F.col("parent"), F.col("copy")), f"{seed}-key") - 1).alias(key),
        *[F.col(c).cast("double").alias(c) for c in columns], *own, *lent, target,
    )
    real = df.select(
        F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in columns], *categories, target
    )
    return real.unionByName(fresh)


def smote_tomek(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 5, seed: int = 42, categories: Sequence[str] = ()
) -> DataFrame:
    """SMOTE, then both sides of every Tomek link are dropped."""
    made = smote(df, target, key, columns, k, seed)
    grown = cut_lineage(with_synthetic(df, made, target, key, columns, seed, categories))
    linked = tomek_links(grown, target, key, columns).select(F.col("key").alias(key))
    return grown.join(linked, key, "left_anti")


def smote_enn(
    df: DataFrame, target: str, key: str, columns: Sequence[str], k: int = 5, seed: int = 42, categories: Sequence[str] = ()
) -> DataFrame:
    """SMOTE, then rows of any class whose three neighbours do not all share their class are dropped."""
    made = smote(df, target, key, columns, k, seed)
    grown = cut_lineage(with_synthetic(df, made, target, key, columns, seed, categories))
    losers = neighbour_mix(grown, grown, target, key, columns, 3).filter("others > 0")
    return grown.join(losers.select(F.col("key").alias(key)), key, "left_anti")


STRATEGIES = {
    "smote": smote, "adasyn": adasyn, "borderline_smote": borderline_smote, "svm_smote": svm_smote,
}


def balance(
    df: DataFrame, strategy: str, target: str, key: str, columns: Sequence[str], seed: int = 42,
    categories: Sequence[str] = (),
) -> DataFrame:
    """Balanced table (key, columns, categories, target) by strategy name.

    No row is dropped for its gaps: rows with a missing number stay as they are and neither spawn nor meet
    neighbours. Fill gaps first where they should take part. Keys may be of any type; a synthetic row has a
    negative number, among text keys as text.
    """
    from riskloom.operators.balance import over_sample, under_sample

    narrow = df.select(key, *columns, *categories, target)
    if strategy not in ("none", "class_weight", "random_over", "random_under") and not has_whole_number(df, key):
        (coded,) = with_key_numbers([narrow], key)
        names = coded.select("_code", F.col(key).cast("string").alias(key))
        grown = balance(coded.drop(key), strategy, target, "_code", columns, seed, categories)
        return grown.join(names, "_code", "left").select(
            F.coalesce(key, F.col("_code").cast("string")).alias(key), *columns, *categories, target
        )
    if strategy in ("none", "class_weight"):
        return narrow
    if strategy in STRATEGIES:
        made = STRATEGIES[strategy](narrow, target, key, columns, seed=seed)
        return with_synthetic(narrow, made, target, key, columns, seed, categories)
    if strategy == "smote_nc":
        made = smote_nc(narrow, target, key, columns, categories, seed=seed)
        return with_synthetic(narrow, made, target, key, columns, seed, categories)
    if strategy == "random_over":
        return over_sample(narrow, target, key, seed).drop("copy")
    if strategy == "random_under":
        return under_sample(narrow, target, key, seed)
    if strategy == "tomek":
        return without_tomek_links(narrow, target, key, columns)
    if strategy == "enn":
        return edited_neighbours(narrow, target, key, columns)
    if strategy == "smote_tomek":
        return smote_tomek(narrow, target, key, columns, seed=seed, categories=categories)
    if strategy == "smote_enn":
        return smote_enn(narrow, target, key, columns, seed=seed, categories=categories)
    raise ValueError(f"unknown strategy {strategy!r}")
