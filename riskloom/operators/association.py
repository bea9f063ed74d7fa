"""Correlations and association tests between columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.tails import chi2_tail, f_tail, normal_tail, t_tail
from riskloom.operators.prefix import range_bits, sums_over_ranges, value_ranks, with_cut_range, with_range, with_range_in_groups
from riskloom.operators.quantiles import clean_double, quantiles
from riskloom.session import cut_lineage

_SPEARMAN_BATCH = 16
_PAIRS_PER_SCAN = 400
_DIGIT_BITS = 2
_BLOCK_COLUMNS = 64


def correlation_band(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.3, "weak").when(size < 0.7, "moderate").when(size.isNotNull(), "strong")


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (a, b, n, sx, sy, sxx, syy, sxy) per pair of columns, a before b, over pairwise complete rows.

    One scan for any number of pairs: every task adds up Gram blocks of ``_BLOCK_COLUMNS`` columns, of the values and of the
    masks of present values, and gives each block once; Spark sums them by block. Values are shifted by their column's
    mean first (one row of means), so that the sums of squares stay small.
    """
    columns = list(columns)
    cleaned = df.select(*[clean_double(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    means = cleaned.agg(*[F.avg(c).alias(c) for c in cleaned.columns]).first()
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    blocks = [slice(n, min(n + _BLOCK_COLUMNS, len(columns))) for n in range(0, len(columns), _BLOCK_COLUMNS)]
    kinds = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - shift
            held = ~np.isnan(x)
            x, m = np.where(held, x, 0.0), held.astype(float)
            for i, p in enumerate(blocks):
                for j, q in enumerate(blocks[i:], i):
                    xp, xq, mp, mq = x[:, p].T, x[:, q], m[:, p].T, m[:, q]
                    part = np.stack([mp @ mq, xp @ mq, mp @ xq, (xp * xp) @ mq, mp @ (xq * xq), xp @ xq])
                    sums[i, j] = sums[i, j] + part if (i, j) in sums else part
        for (i, j), part in sums.items():
            left, right = np.meshgrid(np.arange(blocks[i].start, blocks[i].stop), np.arange(blocks[j].start, blocks[j].stop), indexing="ij")
            once = left < right
            yield pd.DataFrame({"i": left[once], "j": right[once], **{k: part[at][once] for at, k in enumerate(kinds)}})

    schema = "i int, j int, " + ", ".join(f"{k} double" for k in kinds)
    summed = cleaned.mapInPandas(add_up, schema).groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in kinds])
    names = F.array(*[F.lit(c) for c in columns])
    return summed.select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), F.col("n").cast("long").alias("n"), *kinds[1:])


def _pearson_of_moments(moments: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")

    def spread(product: str, left: str, right: str) -> Column:
        return F.col(product) - F.try_divide(F.col(left) * F.col(right), n)

    vx, vy = spread("sxx", "sx", "sx"), spread("syy", "sy", "sy")
    # below this share of the squares a spread is rounding, that is, the column is constant on these rows
    varies = (vx > 1e-14 * F.col("sxx")) & (vy > 1e-14 * F.col("syy"))
    return moments.select("a", "b", F.when(varies, spread("sxy", "sx", "sy") / F.sqrt(vx * vy)).alias("r"), "n")


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (a, b, r, n) over pairwise complete rows, in one scan: built-in correlations for up to a few hundred
    pairs, blocked co-moments beyond."""
    pairs = list(combinations(columns, 2))
    if len(pairs) > _PAIRS_PER_SCAN:
        return _pearson_of_moments(co_moments(df, columns))
    cleaned = df.select(*[clean_double(F.col(c)).alias(c) for c in columns])
    row = cleaned.agg(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.nanvl(F.corr(a, b), F.lit(None).cast("double")).alias("r"),
                F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
            ).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))


def _pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Complete pairs as (pair, x, y, w): equal pairs are combined before any shuffle of single rows."""
    sides = F.array(
        *[
            F.struct(F.lit(n).alias("pair"), clean_double(F.col(a)).alias("x"), clean_double(F.col(b)).alias("y"))
            for n, (a, b) in enumerate(pairs)
        ]
    )
    return (
        df.select(F.inline(sides))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y")
        .agg(F.count("*").alias("w"))
    )


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (a, b, rho, n): correlation of mid-ranks over complete pairs."""
    return _spearman_batch(df, [(a, b)])


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (a, b, rho, n) per pair of columns; a batch of pairs shares every scan and shuffle."""
    pairs = list(combinations(columns, 2))
    batches = [pairs[n : n + _SPEARMAN_BATCH] for n in range(0, len(pairs), _SPEARMAN_BATCH)]
    return reduce(DataFrame.unionByName, [_spearman_batch(df, batch) for batch in batches])


def _spearman_batch(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Ranks come from the distinct values of each side of a pair and are joined back by value.

    Each side is cut into ranges of its own, as columns differ in scale; the rank side of a join has one
    row per value, so a hot value can be split by the adaptive skew join.
    """
    counts = cut_lineage(_pair_counts(df, pairs))
    by = ["pair", "side"]
    values = counts.select(
        "pair",
        "w",
        F.inline(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in "xy"])),
    )
    hist = cut_lineage(values.groupBy(*by, "value").agg(F.sum("w").alias("n")))
    ranked = sums_over_ranges(with_range_in_groups(hist, "value", by), "value", ["n"], by)
    ranked = ranked.withColumn("r", F.col("n_before") + (F.col("n") + 1) / 2.0 - (F.col("n_total") + 1) / 2.0)

    def side(name: str) -> DataFrame:
        return ranked.filter(F.col("side") == name).select("pair", F.col("value").alias(name), F.col("r").alias(f"r{name}"))

    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    found = (
        counts.join(side("x"), ["pair", "x"])
        .join(side("y"), ["pair", "y"])
        .groupBy("pair")
        .agg(
            F.try_divide(F.sum(w * rx * ry), F.sqrt(F.sum(w * rx * rx) * F.sum(w * ry * ry))).alias("rho"),
            F.sum(w).alias("n"),
        )
    )
    names = df.sparkSession.createDataFrame(
        [(n, a, b) for n, (a, b) in enumerate(pairs)], "pair int, a string, b string"
    )
    return names.join(found, "pair", "left").select("a", "b", "rho", F.coalesce("n", F.lit(0)).alias("n"))


def _discordant(counts: DataFrame, order: str, coded: str) -> DataFrame:
    """One row (d): weight of the pairs of rows that ``order`` and ``coded`` put in opposite order.

    The values of ``coded`` become dense ranks, read as digits of two bits. Two ranks part at exactly one digit, below
    a common prefix, so a discordant pair is met once: in the group (digit place, prefix), where the row that is earlier
    in ``order`` has the larger digit. Whole ranges of ``order`` meet through sums per range; inside a range a
    running sum per digit does. A value hot enough to be a cut has a range of its own and no pair inside.
    """
    values = cut_lineage(counts.select(coded).distinct().withColumn("one", F.lit(1).cast("long")))
    codes = sums_over_ranges(with_range(values, coded, ["one"]), coded, ["one"]).select(coded, F.col("one_before").alias("code"))
    places = max(1, -(-(values.count() - 1).bit_length() // _DIGIT_BITS))
    ranged = with_cut_range(counts, order, range_bits(counts))
    rows = cut_lineage(ranged.join(codes, coded).select(F.col(order).alias("at"), "_range", "code", "w"))

    def shift(n: str) -> Column:
        return F.expr(f"shiftright(code, {n})")

    placed = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).select(
        "at", "_range", "w", "place",
        shift(f"{_DIGIT_BITS} * (place + 1)").alias("prefix"),
        shift(f"{_DIGIT_BITS} * place").bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1)).alias("digit"),
    )
    digits = range(1 << _DIGIT_BITS)
    group = ["place", "prefix"]
    per_range = placed.groupBy(*group, "_range").agg(
        *[F.sum(F.when(F.col("digit") == d, F.col("w")).otherwise(F.lit(0))).cast("double").alias(f"w{d}") for d in digits]
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.coalesce(F.sum(sum(F.col(f"w{e}") for e in digits if e > d)).over(earlier), F.lit(0.0)) for d in digits[:-1]]
    across = per_range.select(sum(F.col(f"w{d}") * above[d] for d in digits[:-1]).alias("d"))

    inside = Window.partitionBy(*group, "_range").orderBy("at", "digit").rowsBetween(Window.unboundedPreceding, -1)
    larger = [F.coalesce(F.sum(F.when(F.col("digit") > d, F.col("w"))).over(inside), F.lit(0)) for d in digits[:-1]]
    seen = F.lit(0).cast("long")
    for d in digits[:-1]:
        seen = F.when(F.col("digit") == d, larger[d]).otherwise(seen)
    within = placed.filter(F.col("_range") % 2 == 1).select((F.col("w").cast("double") * seen).alias("d"))
    return across.unionByName(within).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (a, b, tau, n): exact Kendall tau-b without comparing all pairs of rows.

    Discordant pairs are counted digit by digit of the ranks of the axis with fewer distinct values; pairs tied on
    an axis follow from value counts, and the concordant ones are the rest. Null without a pair untied on both axes.
    """
    counts = cut_lineage(_pair_counts(df, [(a, b)]).drop("pair"))  # read by every step below
    sizes = counts.agg(F.approx_count_distinct("x").alias("x"), F.approx_count_distinct("y").alias("y")).first()
    order, coded = ("x", "y") if sizes["y"] <= sizes["x"] else ("y", "x")

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    def tied(*axes: str) -> Column:
        per_value = counts.groupBy(*axes).agg(F.sum("w").cast("double").alias("m"))
        return per_value.agg(F.sum(pairs(F.col("m")))).scalar()

    total = counts.agg(F.sum("w")).scalar()
    whole = pairs(F.col("n").cast("double"))
    untied = whole - F.col("tx") - F.col("ty") + F.col("txy")
    return _discordant(counts, order, coded).select(
        "d", total.alias("n"), tied("x").alias("tx"), tied("y").alias("ty"), tied("x", "y").alias("txy")
    ).select(
        F.lit(a).alias("a"), F.lit(b).alias("b"),
        F.try_divide(untied - 2 * F.col("d"), F.sqrt((whole - F.col("tx")) * (whole - F.col("ty")))).alias("tau"),
        "n",
    )


def numeric_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Pearson and Spearman with p-values and strength; null below three complete rows."""
    joined = pearson_pairs(df, [a, b]).join(spearman(df, a, b).drop("n"), ["a", "b"])
    dof = (F.col("n") - 2).cast("double")

    def t_of(r: str) -> Column:
        c = F.col(r)
        return F.when(F.abs(c) < 1, c * F.sqrt(dof / (1 - c * c))).when(
            c.isNotNull(), F.lit(float("inf"))
        )

    return joined.filter(F.col("n") >= 3).select(
        "a", "b", "n",
        F.col("r").alias("pearson_r"),
        t_tail(t_of("r"), dof).alias("pearson_p"),
        F.col("rho").alias("spearman_r"),
        t_tail(t_of("rho"), dof).alias("spearman_p"),
        correlation_band(F.col("r")).alias("strength"),
    ).withColumn("significant", F.col("pearson_p") < alpha)


def anova_test(df: DataFrame, numeric: str, category: str, alpha: float = 0.05) -> DataFrame:
    """One-way analysis of variance over groups with at least two values."""
    x = clean_double(F.col(numeric))
    rows = df.select(x.alias("x"), F.col(category).cast("string").alias("g")).filter(
        F.col("x").isNotNull() & F.col("g").isNotNull()
    )
    centre = rows.agg(F.avg("x")).scalar()  # shift: keeps the sums of squares small
    groups = (
        rows.withColumn("x", F.col("x") - centre)
        .groupBy("g")
        .agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
        .filter(F.col("n") >= 2)
    )
    n, m = F.col("n"), F.col("m")
    sums = groups.agg(
        F.count("*").alias("n_groups"),
        F.sum(n).alias("n"),
        (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias("between"),
        F.sum((n - 1) * F.col("v")).alias("within"),
    ).filter(F.col("n_groups") >= 2)
    d1, d2 = F.col("n_groups") - 1, F.col("n") - F.col("n_groups")
    f = F.try_divide(F.col("between") / d1, F.col("within") / d2)
    return sums.select(
        F.lit(numeric).alias("numeric"), F.lit(category).alias("category"), "n_groups", "n",
        f.alias("f_statistic"), f_tail(f, d1.cast("double"), d2.cast("double")).alias("p_value"),
    ).withColumn("significant", F.col("p_value") < alpha)


def chi2_cells(cells: DataFrame) -> DataFrame:
    """Chi-square (with continuity correction for 2x2), degrees of freedom and Cramer's V.

    ``cells`` has (x, y, o) with positive counts; empty cells follow from the margins.
    """
    total = cells.agg(F.sum("o")).scalar()
    rows = cells.groupBy("x").agg(F.sum("o").cast("double").alias("rx"))
    columns = cells.groupBy("y").agg(F.sum("o").cast("double").alias("cy"))
    n = total.cast("double")
    shape = rows.agg(F.count("*").alias("k"), F.sum(1 / F.col("rx")).alias("inv_x"))
    shape_y = columns.agg(F.count("*").alias("l"), F.sum(1 / F.col("cy")).alias("inv_y"))
    expected = cells.join(rows, "x").join(columns, "y").withColumn("e", F.col("rx") * F.col("cy") / n)
    sums = expected.agg(
        F.sum("o").cast("double").alias("n"),
        # empty cells add their expected count, and all expected counts sum to n
        (F.sum(F.col("o") * F.col("o") / F.col("e")) - F.sum("o")).alias("plain"),
        F.max(F.abs(F.col("o") - F.col("e"))).alias("off"),
    ).withColumns(
        {
            "k": shape.select("k").scalar(),
            "l": shape_y.select("l").scalar(),
            "inv": shape.select("inv_x").scalar() * shape_y.select("inv_y").scalar(),
        }
    )
    # in a 2x2 table all four cells are off by the same amount
    corrected = F.pow(F.greatest(F.col("off") - 0.5, F.lit(0.0)), 2) * F.col("n") * F.col("inv")
    chi2 = F.when((F.col("k") == 2) & (F.col("l") == 2), corrected).otherwise(F.col("plain"))
    smaller = F.least(F.col("k"), F.col("l")) - 1
    return sums.select(
        F.col("n").cast("long").alias("n"),
        chi2.alias("chi2"),
        ((F.col("k") - 1) * (F.col("l") - 1)).alias("dof"),
        F.sqrt(F.try_divide(chi2, F.col("n") * smaller)).alias("cramers_v"),
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cell counts (x, y, o) over rows where both are present."""
    rows = df.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
    return rows.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("o"))


def chi2_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    measured = chi2_cells(contingency(df, a, b))
    v = F.col("cramers_v")
    return measured.select(
        F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "chi2", "dof",
        chi2_tail("chi2", F.col("dof").cast("double")).alias("p_value"),
        "cramers_v",
        F.when(v < 0.1, "weak").when(v < 0.3, "moderate").when(v.isNotNull(), "strong").alias("strength"),
    ).withColumn("significant", F.col("p_value") < alpha)


def pair_test(df: DataFrame, a: str, b: str, numeric: Sequence[str]) -> DataFrame:
    """Test that fits the two column kinds, as (a, b, test, statistic, p_value, significant)."""
    if a in numeric and b in numeric:
        t = numeric_test(df, a, b).select(
            "a", "b", F.lit("correlation").alias("test"), F.col("pearson_r").alias("statistic"),
            F.col("pearson_p").alias("p_value"), "significant",
        )
    elif a in numeric or b in numeric:
        number, category = (a, b) if a in numeric else (b, a)
        t = anova_test(df, number, category).select(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit("anova").alias("test"),
            F.col("f_statistic").alias("statistic"), "p_value", "significant",
        )
    else:
        t = chi2_test(df, a, b).select(
            "a", "b", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "p_value", "significant"
        )
    return t


def mann_whitney(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """U of the rows with ``group`` = 1 against ``group`` = 0, with tie-corrected normal p-value."""
    from riskloom.operators.evaluate import ranked_scores

    by = list(by)
    ranked = ranked_scores(df, group, value, by)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    t = pos + neg
    sums = ranked.groupBy(*by).agg(
        F.max("pos_total").alias("n1"),
        F.max("neg_total").alias("n0"),
        F.sum(pos * (F.col("neg_before") + neg / 2)).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0)), sd)
    return sums.select(*by, "n1", "n0", "u", normal_tail(z).alias("p_value"))


def outcome_comparison(
    df: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Per variable and outcome group: n, mean, sd, quartiles, range, or count and percent per level.

    p-values: Mann-Whitney for numbers, chi-square for categories.
    """
    rows = df.filter(F.col(outcome).isNotNull())
    virtual = {
        f"{c}|{g}": F.when(F.col(outcome) == g, clean_double(F.col(c))) for c in numeric for g in (0, 1)
    }
    quartiles = quantiles(rows, virtual, [0.25, 0.5, 0.75])
    moments = rows.agg(
        *[
            F.struct(
                F.lit(name.rsplit("|", 1)[0]).alias("variable"),
                F.lit(int(name[-1])).alias("outcome"),
                F.lit(None).cast("string").alias("level"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd"),
                *[
                    F.lit(v).cast("double").alias(q)
                    for q, v in zip(("q25", "median", "q75"), quartiles[name])
                ],
                F.min(x).alias("low"),
                F.max(x).alias("high"),
                F.lit(None).cast("double").alias("pct"),
            ).alias(f"m{i}")
            for i, (name, x) in enumerate(virtual.items())
        ]
    )
    table = moments.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(virtual))])))
    long = rows.select(
        F.col(outcome).cast("int").alias("outcome"), *[clean_double(F.col(c)).alias(c) for c in numeric]
    ).unpivot(["outcome"], list(numeric), "variable", "x")
    tests = mann_whitney(long, "x", "outcome", ["variable"]).select("variable", "p_value")
    for c in categorical:
        cells = contingency(rows, outcome, c).select(F.col("x").cast("int").alias("outcome"), F.col("y").alias("level"), F.col("o").alias("n"))
        groups = cells.groupBy("outcome").agg(F.sum("n").alias("total"))
        empty = [F.lit(None).cast("double").alias(s) for s in ("mean", "sd", "q25", "median", "q75", "low", "high")]
        shares = cells.join(groups, "outcome").select(
            F.lit(c).alias("variable"), "outcome", "level", "n", *empty,
            (100.0 * F.col("n") / F.col("total")).alias("pct"),
        )
        table = table.unionByName(shares)
        tests = tests.unionByName(
            chi2_test(rows, outcome, c).select(F.lit(c).alias("variable"), "p_value")
        )
    return table.join(tests, "variable", "left")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and r2 of y on x."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def drift_check(
    before: DataFrame, after: DataFrame, target: str, age: str, band: Column, key: str
) -> DataFrame:
    """Long (version, band, stat, value): size, distinct rows, target rate, age moments, correlation,
    and the target rate per band, for two versions of a table."""
    fields = [F.col(key).alias("k"), F.col(target).cast("double").alias("y"), F.col(age).cast("double").alias("age"), band.alias("band")]
    both = before.select(F.lit("before").alias("version"), *fields).unionByName(
        after.select(F.lit("after").alias("version"), *fields)
    )
    whole = both.groupBy("version").agg(
        F.count("*").cast("double").alias("n"),
        F.avg("y").alias("target_rate"),
        F.avg("age").alias("age_mean"),
        F.stddev_samp("age").alias("age_sd"),
        F.corr("age", "y").alias("age_target_r"),
    )
    content = both.groupBy("version", "y", "age", "band").agg(F.lit(1).alias("one"))
    distinct = content.groupBy("version").agg(F.count("*").cast("double").alias("distinct_rows"))
    per_band = both.groupBy("version", "band").agg(
        F.count("*").cast("double").alias("n"), F.avg("y").alias("target_rate")
    )
    stats = ["n", "target_rate", "age_mean", "age_sd", "age_target_r", "distinct_rows"]
    return (
        whole.join(distinct, "version")
        .withColumn("band", F.lit("all"))
        .unpivot(["version", "band"], stats, "stat", "value")
        .unionByName(per_band.unpivot(["version", "band"], ["n", "target_rate"], "stat", "value"))
    )


def eda_summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], tests: DataFrame | None = None) -> DataFrame:
    """Shape, missing cells, share of skewed numeric columns, and number of significant pairs."""
    from riskloom.operators.profile import sample_skewness

    columns = [*numeric, *categorical]
    missing = reduce(lambda a, b: a + b, [F.count("*") - F.count(c) for c in columns])
    skewed = reduce(
        lambda a, b: a + b,
        [F.coalesce((F.abs(sample_skewness(c)) > 1).cast("int"), F.lit(0)) for c in numeric],
        F.lit(0),
    )
    row = df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(columns)).alias("n_columns"),
        F.lit(len(numeric)).alias("n_numeric"),
        F.lit(len(categorical)).alias("n_categorical"),
        missing.alias("missing_cells"),
        (skewed / F.lit(float(max(len(numeric), 1)))).alias("skewed_share"),
    )
    if tests is not None:
        row = row.withColumn("significant_pairs", tests.agg(F.count_if("significant")).scalar())
    return row

