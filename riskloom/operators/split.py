"""Reproducible splits with exact sizes.

Rows get a hash of their key and a seed. The row count below a hash value is found by exact order
statistics, so a split is one comparison per row: no sort, no shuffle, the same on any cluster.
Keys must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_order
from riskloom.operators.prefix import has_whole_number
from riskloom.operators.quantiles import OrderStatistic, order_statistics
from riskloom.session import cut_lineage, drop_table

MAX_CLASSES = 1_000


def class_counts(df: DataFrame, target: str, most: int = MAX_CLASSES) -> dict[object, int]:
    """Rows per class; fails beyond ``most`` classes, as each becomes an entry on the driver."""
    rows = df.groupBy(target).agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{target!r} has more than {most} classes; raise ``most`` if it is a class label")
    return {r[0]: r.n for r in rows}


def _class_test(target: str | None, value: object) -> Column:
    if target is None:
        return F.lit(True)
    return F.col(target).isNull() if value is None else F.col(target) == F.lit(value)


def first_rows(
    df: DataFrame, orders: Sequence[Column], key: str, sizes: dict[object, Sequence[int]], target: str | None = None
) -> list[dict[tuple[object, int], Column]]:
    """For each order, per class and size m: a condition that holds for exactly the first m rows in (order, key)."""
    classes = [(n, v) for n in range(len(orders)) for v in sizes]
    names = {at: f"c{i}" for i, at in enumerate(classes)}
    ranks = {names[n, v]: sorted({m - 1 for m in sizes[v] if m > 0}) for n, v in classes}
    stats = {}
    if any(ranks.values()):
        # the orders (hashes, as a rule) are worked out once for all scans
        kept = [F.col(target).alias("class")] if target is not None else []
        once = cut_lineage(df.select(*[o.alias(f"o{n}") for n, o in enumerate(orders)], *kept))
        inside = {v: _class_test(None if target is None else "class", v) for v in sizes}
        stats = order_statistics(once, {names[n, v]: F.when(inside[v], F.col(f"o{n}")) for n, v in classes}, ranks)
        drop_table(once)
    return [
        {
            (v, m): _among_first(df, order, key, _class_test(target, v), m, stats.get((names[n, v], m - 1)))
            for v, ms in sizes.items()
            for m in ms
        }
        for n, order in enumerate(orders)
    ]


def _among_first(
    df: DataFrame, order: Column, key: str, inside: Column, m: int, stat: OrderStatistic | None
) -> Column:
    if m <= 0:
        return F.lit(False)
    if stat is None:  # more rows wanted than there are
        return inside
    cut, take = F.lit(stat.value), m - stat.below
    if take == stat.equal:
        return inside & (order <= cut)
    # equal order values: go on by key, a text key by its place among the tied ones
    if has_whole_number(df, key):
        tied = {"k": F.when(inside & (order == cut), F.col(key).cast("bigint"))}
        last = order_statistics(df, tied, {"k": [take - 1]})[("k", take - 1)].value
        return inside & ((order < cut) | ((order == cut) & (F.col(key).cast("bigint") <= F.lit(last))))
    tied = df.filter(inside & (order == cut)).select(F.col(key).cast("string").alias("k"))
    last = tied.orderBy("k").limit(take).agg(F.max("k")).first()[0]
    return inside & ((order < cut) | ((order == cut) & (F.col(key).cast("string") <= F.lit(last))))


def random_split(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``split``: exactly ceil(fraction * n) rows are test."""
    n = df.count()
    size = math.ceil(n * fraction - 1e-9)
    test = first_rows(df, [hash_order(key, seed)], key, {None: [size]})[0][(None, size)]
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def temporal_split(df: DataFrame, ts: str, key: str, fraction: float = 0.2) -> DataFrame:
    """Newest floor(fraction * n) rows are test; a fraction too small for one row gives no test rows."""
    n = df.count()
    size = math.floor(n * fraction + 1e-9)
    moment = micros(ts)
    train = first_rows(df, [moment], key, {None: [n - size]})[0][(None, n - size)]
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, F.col(ts).cast("timestamp_ntz"))


def stratified_split(
    df: DataFrame, target: str, key: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Class shares kept: floor(fraction * n_c + 1/2) rows of each class are test."""
    counts = class_counts(df, target)
    sizes = {v: [math.floor(n * fraction + 0.5)] for v, n in counts.items()}
    tests = first_rows(df, [hash_order(key, seed)], key, sizes, target)[0]
    expr = F.lit(False)
    for condition in tests.values():
        expr = expr | F.coalesce(condition, F.lit(False))
    return df.withColumn("split", F.when(expr, "test").otherwise("train"))


def split_rows(
    df: DataFrame, key: str, target: str | None = None, ts: str | None = None, stratify: bool = True,
    fraction: float = 0.2, seed: int = 42,
) -> DataFrame:
    """By time when there is a time column, else by class when asked, else at random."""
    if ts is not None:
        return temporal_split(df, ts, key, fraction)
    if stratify and target is not None:
        return stratified_split(df, target, key, fraction, seed)
    return random_split(df, key, fraction, seed)


def stratified_folds(
    df: DataFrame, target: str, key: str, k: int = 5, repeats: int = 1, seed: int = 42
) -> DataFrame:
    """Columns ``fold_0`` .. ``fold_{repeats-1}``: class-balanced folds, sizes differ by at most one.

    Fold f of a class holds its rows between the hash ranks f*n/k and (f+1)*n/k.
    """
    counts = class_counts(df, target)
    sizes = {v: [math.ceil(n * f / k) for f in range(1, k)] for v, n in counts.items()}
    orders = [hash_order(key, f"{seed}-{r}") for r in range(repeats)]
    for r, before in enumerate(first_rows(df, orders, key, sizes, target)):
        fold = F.lit(0)
        for v in sizes:
            reached = sum(
                (F.when(before[(v, m)], 0).otherwise(F.lit(1)) for m in sizes[v]), F.lit(0)
            )
            fold = F.when(_class_test(target, v), reached).otherwise(fold)
        df = df.withColumn(f"fold_{r}", fold)
    return df
