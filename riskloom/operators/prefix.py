"""Running sums over a globally ordered table without a single-task sort.

The order column is cut into ranges at its own approximate quantiles: four for each shuffle partition of
the session, 256 at least and 4,096 at most. Sums inside a range come from a window partitioned by that
range; sums of all earlier ranges come from a table with one row per range. The ranges only decide where
the work happens: the result is exact.

Callers aggregate to one row per distinct value first, so a hot value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

RANGE_BITS, MOST_RANGE_BITS = 8, 12
#: Sampled texts per range, and the characters of each that a cut keeps.
TEXTS_PER_RANGE, CUT_CHARACTERS = 16, 256


def range_bits(df: DataFrame) -> int:
    """Ranges follow the shuffle partitions of the session, as powers of two."""
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(RANGE_BITS, (wanted - 1).bit_length()), MOST_RANGE_BITS)


def range_of(value: Column, cuts: Column, bits: int = RANGE_BITS) -> Column:
    """How many of the ``2 ** bits - 1`` sorted cut points are <= value (binary search, stays in the JVM)."""
    steps = ", ".join(str(1 << bit) for bit in reversed(range(bits)))
    return F.aggregate(
        F.expr(f"array({steps})"),
        F.lit(0),
        lambda found, step: found
        + F.when(F.element_at(cuts, found + step) <= value, step).otherwise(F.lit(0)),
    )


def _quantile_cuts(order: str, bits: int) -> Column:
    # one split text instead of many literals: every later plan step stays cheap to analyse
    fractions = ",".join(str((i + 1) / (1 << bits)) for i in range((1 << bits) - 1))
    return F.expr(
        f"percentile_approx(`{order}`, cast(split('{fractions}', ',') AS array<double>), {max(10_000, 8 << bits)})"
    )


def with_range(df: DataFrame, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``_range`` = position of ``order`` among its own quantile cuts (one lazy subquery).

    ``keep`` columns are aggregated along, so that the subquery reads the same exchange as the
    main query instead of a narrower one.
    """
    bits = range_bits(df)
    cuts = df.agg(
        F.struct(_quantile_cuts(order, bits).alias("cuts"), *[F.max(c).alias(f"max_{c}") for c in keep]).alias("s")
    ).scalar()
    bounded = df.withColumn("_cuts", cuts["cuts"])  # the same for every row
    return bounded.withColumn("_range", range_of(F.col(order), F.col("_cuts"), bits)).drop("_cuts")


def with_range_in_groups(df: DataFrame, order: str, by: Sequence[str]) -> DataFrame:
    """Like ``with_range`` with cuts of each group's own; for few groups, each one row of cuts."""
    bits = range_bits(df)
    cuts = df.groupBy(*by).agg(_quantile_cuts(order, bits).alias("_cuts"))
    bounded = df.join(cuts, list(by))
    return bounded.withColumn("_range", range_of(F.col(order), F.col("_cuts"), bits)).drop("_cuts")


def with_cut_range(df: DataFrame, order: str, bits: int = RANGE_BITS) -> DataFrame:
    """Like ``with_range`` with ``2 ** bits`` ranges, but a cut value is a range of its own (even numbers), so that a
    hot value never shares its range with others."""
    bounded = df.withColumn("_cuts", df.agg(_quantile_cuts(order, bits)).scalar())
    below = range_of(F.col(order), F.col("_cuts"), bits)
    on_cut = F.coalesce(F.get("_cuts", F.col("_range") - 1) == F.col(order), F.lit(False))
    return (
        bounded.withColumn("_range", below)
        .withColumn("_range", 2 * F.col("_range") + F.when(on_cut, 0).otherwise(F.lit(1)))
        .drop("_cuts")
    )


def with_text_range(df: DataFrame, text: str) -> DataFrame:
    """Add ``_range`` by cuts at a hash sample of the texts, so that a common prefix does not fill one range."""
    bits = range_bits(df)
    sample = (
        df.filter(F.col(text).isNotNull())
        .select(F.substring(text, 1, CUT_CHARACTERS).alias("cut"), F.xxhash64(text).alias("h"))
        .orderBy("h").limit(TEXTS_PER_RANGE << bits)
    )
    ordered = F.sort_array(F.collect_list("cut"))
    cuts = sample.agg(
        F.transform(
            F.sequence(F.lit(1), F.lit((1 << bits) - 1)),
            lambda i: F.get(ordered, F.floor(i * F.size(ordered) / (1 << bits)).cast("int")),
        )
    ).scalar()
    bounded = df.withColumn("_cuts", cuts)
    return bounded.withColumn("_range", range_of(F.col(text), F.col("_cuts"), bits)).drop("_cuts")


def running_sums(
    table: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``{c}_before`` (sum over smaller ``order`` values) and ``{c}_total`` for each ``c`` in sums.

    ``table`` has one row per (by, order value), ``order`` is a number; ``by`` columns must not be null.
    """
    ranged = with_range(table, order, [*by, *sums])
    return sums_over_ranges(ranged, order, sums, by).drop("_range")


def sums_over_ranges(
    ranged: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``running_sums`` on a table that already carries its ``_range`` column."""
    by = list(by)
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_range.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(offsets, [*by, "_range"])
        .withColumns(
            {
                f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_off_{c}")
                for c in sums
            }
        )
        .drop(*[f"_off_{c}" for c in sums])
    )


def value_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per (by, value): ``n``, ``n_before``, ``n_total`` and the mid-rank of the value.

    ``weight`` counts how many original rows a row stands for.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    ranked = running_sums(cut_lineage(counts), value, ["n"], by)
    return ranked.withColumn("midrank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def weighted_quantile(df: DataFrame, value: str, weight: str, prob: float) -> float | None:
    """Linear-interpolated quantile when each row stands for ``weight`` rows."""
    ranked = value_ranks(df, value, weight=weight)
    h = (F.col("n_total") - 1) * F.lit(prob)
    inside = lambda at: (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
    row = ranked.agg(
        F.max(F.when(inside(F.floor(h)), F.col(value))).alias("low"),
        F.max(F.when(inside(F.ceil(h)), F.col(value))).alias("high"),
        F.max(h - F.floor(h)).alias("part"),
    ).first()
    return None if row.low is None else row.low + (row.high - row.low) * row.part


def text_numbers(values: DataFrame, text: str) -> DataFrame:
    """Distinct texts numbered 0.. in byte order as (text, code long), without one global sort task."""
    distinct = cut_lineage(values.select(text).distinct().withColumn("n", F.lit(1).cast("long")))
    ranked = sums_over_ranges(with_text_range(distinct, text), text, ["n"])
    return ranked.select(text, F.col("n_before").alias("code"))


def text_codes(values: DataFrame, text: str) -> DataFrame:
    """``text_numbers`` as int codes."""
    return text_numbers(values, text).withColumn("code", F.col("code").cast("int"))


def has_whole_number(df: DataFrame, key: str) -> bool:
    return dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")


def with_key_numbers(frames: Sequence[DataFrame], key: str, number: str = "_code") -> list[DataFrame]:
    """The frames with a long column that numbers their common keys of any type, in text order."""
    texts = [f.select(F.col(key).cast("string").alias("_text")) for f in frames]
    every = texts[0]
    for t in texts[1:]:
        every = every.unionByName(t)
    codes = cut_lineage(text_numbers(every, "_text").withColumnRenamed("code", number))
    return [f.join(codes, F.col(key).cast("string").eqNullSafe(codes["_text"])).drop("_text") for f in frames]


def fill_from_neighbour(
    df: DataFrame, columns: Sequence[str], order: str, by: Sequence[str] = (),
    backward: bool = False,
) -> DataFrame:
    """Fill nulls with the nearest earlier (or later) non-null value in ``order``.

    ``order`` must be unique inside ``by``. A long group (one hot key, or no key at all) is worked
    on range by range; the last value of the earlier ranges is carried over by a small join.
    """
    by = list(by)
    ranged = with_range(df, order, [*by, *columns])
    direction = F.col(order).desc() if backward else F.col(order).asc()
    range_direction = F.col("_range").desc() if backward else F.col("_range").asc()
    inside = (
        Window.partitionBy(*by, "_range").orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    pick = F.min_by if backward else F.max_by
    last = ranged.groupBy(*by, "_range").agg(
        *[
            pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}")
            for c in columns
        ]
    )
    earlier = (
        Window.partitionBy(*by).orderBy(range_direction)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = last.select(
        *by,
        "_range",
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
    )
    filled = ranged.join(carried, [*by, "_range"]).withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}"))
            for c in columns
        }
    )
    return filled.select(*df.columns)
