"""Exact order statistics and quantiles whose memory does not grow with the data.

Every column starts as one open interval. A sketch proposes two cuts around each wanted rank, one scan
counts the rows below and at each cut, and the rank is either found at a cut or lies in one of the
smaller intervals between them. Intervals are cut again until they hold at most ``BRACKET_ROWS`` rows,
and only those rows are ranked. The counts decide, not the sketch, so the answer is exact; a hot value
becomes a cut and never enters a ranking. Nothing but counts and one value per rank reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of an interval that one task ranks.
BRACKET_ROWS = 10_000
#: Sketch size; its rank error is at most one in so many rows.
ACCURACY = 2_000
#: Wanted ranks that share one scan.
RANKS_PER_SCAN = 64


@dataclass(frozen=True)
class OrderStatistic:
    """Value at a 0-based rank, with the rows strictly below it and the rows equal to it."""

    value: float | int
    below: int
    equal: int


def count_values(df: DataFrame, values: Mapping[str, Column]) -> dict[str, int]:
    """Non-null count of each named expression, in one scan."""
    row = df.agg(*[F.count(c).alias(name) for name, c in values.items()]).first()
    return {name: row[name] for name in values}


@dataclass(frozen=True)
class _Interval:
    """Open interval of one column: ``before`` rows up to its lower end, ``inside`` rows in it."""

    name: str
    low: float | int | None
    high: float | int | None
    before: int
    inside: int
    ranks: tuple[int, ...]
    uncut: bool = False  # the sketch has no value left to cut at

    @property
    def value(self) -> str:
        return "`" + self.name.replace("`", "``") + "`"

    def holds(self) -> str:
        """SQL text: one parsed text is far cheaper to build than a tree of columns."""
        tests = [f"{self.value} IS NOT NULL"]
        if self.low is not None:
            tests.append(f"{self.value} > {_literal(self.low)}")
        if self.high is not None:
            tests.append(f"{self.value} < {_literal(self.high)}")
        return "(" + " AND ".join(tests) + ")"


def _literal(value: float | int) -> str:
    return f"double('{value!r}')" if isinstance(value, float) else f"{value}L"


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int] | None = None,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[tuple[str, int], OrderStatistic]:
    """Exact values at 0-based ``ranks`` of each named expression (double or bigint)."""
    counts = counts or count_values(df, values)
    narrow = df.select(*[c.alias(name) for name, c in values.items()])
    intervals = []
    for name, rank_list in ranks.items():
        wanted = tuple(sorted({r for r in rank_list if 0 <= r < counts[name]}))
        if wanted:
            intervals.append(_Interval(name, None, None, 0, counts[name], wanted))
    found: dict[tuple[str, int], OrderStatistic] = {}
    ready: list[_Interval] = []
    while intervals:
        ready += [i for i in intervals if i.inside <= bracket_rows or i.uncut]
        wide = [i for i in intervals if i.inside > bracket_rows and not i.uncut]
        intervals = []
        for batch in _batches(wide):
            at_cuts, smaller = _cut(narrow, batch)
            found |= at_cuts
            intervals += smaller
    for batch in _batches(ready):
        found |= _ranked(narrow, batch)
    return found


def _batches(intervals: Sequence[_Interval]) -> list[list[_Interval]]:
    out: list[list[_Interval]] = []
    room = 0
    for interval in intervals:
        if not out or room < len(interval.ranks):
            out.append([])
            room = RANKS_PER_SCAN
        out[-1].append(interval)
        room -= len(interval.ranks)
    return out


def _cut(
    narrow: DataFrame, batch: Sequence[_Interval]
) -> tuple[dict[tuple[str, int], OrderStatistic], list[_Interval]]:
    """Ranks that lie at a sketched cut, and the intervals between cuts for the others."""
    margin = 2 / ACCURACY
    sketches = []
    for n, i in enumerate(batch):
        places = [(r - i.before) / i.inside for r in i.ranks]
        points = sorted({min(max(p + side, 0.0), 1.0) for p in places for side in (-margin, margin)})
        sketches.append(
            F.expr(
                f"percentile_approx(CASE WHEN {i.holds()} THEN {i.value} END, "
                f"array({', '.join(map(_literal, points))}), {ACCURACY})"
            ).alias(f"s{n}")
        )
    row = narrow.agg(*sketches).first()
    cuts = [
        [
            c for c in sorted(set(row[n]))
            if (i.low is None or c > i.low) and (i.high is None or c < i.high)
        ]
        for n, i in enumerate(batch)
    ]
    tallies = [
        tally
        for n, i in enumerate(batch)
        for j, c in enumerate(cuts[n])
        for tally in (
            F.expr(f"count_if({i.holds()} AND {i.value} < {_literal(c)})").alias(f"lt{n}_{j}"),
            F.expr(f"count_if({i.value} = {_literal(c)})").alias(f"eq{n}_{j}"),
        )
    ]
    row = narrow.agg(*tallies).first() if tallies else None
    found, smaller = {}, []
    for n, i in enumerate(batch):
        # ends of the pieces: value, rows before it, rows up to and including it
        ends = [(i.low, 0, 0)]
        for j, c in enumerate(cuts[n]):
            below = row[f"lt{n}_{j}"]
            ends.append((c, below, below + row[f"eq{n}_{j}"]))
        ends.append((i.high, i.inside, i.inside))
        for (low, _, start), (high, stop, after) in zip(ends, ends[1:]):
            inner = tuple(r for r in i.ranks if start <= r - i.before < stop)
            if inner:
                inside = stop - start
                smaller.append(_Interval(i.name, low, high, i.before + start, inside, inner, inside == i.inside))
            for r in i.ranks:
                if stop <= r - i.before < after:
                    found[(i.name, r)] = OrderStatistic(high, i.before + stop, after - stop)
    return found, smaller


def _ranked(narrow: DataFrame, batch: Sequence[_Interval]) -> dict[tuple[str, int], OrderStatistic]:
    """Ranks of intervals that are small enough to be ordered by one task each."""
    types = dict(narrow.dtypes)
    found = {}
    for kind in ("bigint", "double"):
        picks = [(g, i) for g, i in enumerate(batch) if (types[i.name] == "double") == (kind == "double")]
        if not picks:
            continue
        entries = [
            f"CASE WHEN {i.holds()} THEN named_struct('g', {g}, 'v', CAST({i.value} AS {kind})) END" for g, i in picks
        ]
        held = narrow.filter(" OR ".join(i.holds() for _, i in picks))
        long = held.select(F.expr(f"inline(array_compact(array({', '.join(entries)})))"))
        hist = long.groupBy("g", "v").agg(F.count("*").alias("n"))
        before = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = hist.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        hit = " OR ".join(
            f"(g = {g} AND before <= {rank - i.before}L AND {rank - i.before}L < before + n)"
            for g, i in picks
            for rank in i.ranks
        )
        for row in ranked.filter(hit).collect():  # at most one row per wanted rank
            i = batch[row.g]
            for rank in i.ranks:
                if row.before <= rank - i.before < row.before + row.n:
                    found[(i.name, rank)] = OrderStatistic(row.v, i.before + row.before, row.n)
    return found


def quantiles(
    df: DataFrame,
    values: Mapping[str, Column | str] | Sequence[str],
    probs: Sequence[float],
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles, the definition of SQL ``quantile_cont``."""
    if not isinstance(values, Mapping):
        values = {c: F.col(c) for c in values}
    columns = {
        name: clean_double(F.col(c) if isinstance(c, str) else c) for name, c in values.items()
    }
    if not columns:
        return {}
    counts = count_values(df, columns)
    places = {
        name: [(counts[name] - 1) * p if counts[name] else None for p in probs] for name in columns
    }
    ranks = {
        name: sorted({r for h in hs if h is not None for r in (math.floor(h), math.ceil(h))})
        for name, hs in places.items()
    }
    stats = order_statistics(df, columns, ranks, counts, bracket_rows)
    out: dict[str, list[float | None]] = {}
    for name, hs in places.items():
        row: list[float | None] = []
        for h in hs:
            if h is None:
                row.append(None)
                continue
            low = stats[(name, math.floor(h))].value
            high = stats[(name, math.ceil(h))].value
            row.append(float(low + (high - low) * (h - math.floor(h))))
        out[name] = row
    return out


def clean_double(c: Column) -> Column:
    """Double with NaN read as missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)
