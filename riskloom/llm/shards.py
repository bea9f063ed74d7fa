"""Sharding by histogram sort: probe key boundaries are counted exactly, refined, then rows move once.

Rows are ordered by (hash of text, hash of doc_id), so equal texts lie together. Each round counts the exact bytes
below a set of probes that subdivide the still open brackets; a splitter is settled as soon as one of its probes
meets the tolerance. Only then are the rows exchanged, once, by the settled cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import guarded
from riskloom.session import cut_lineage

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def _counted(rows: DataFrame, column: str, bits: int, brackets: list[int] | None, parent_bits: int) -> list:
    """Exact bytes of every bin of the top ``bits`` of a key, only inside the open brackets."""
    if brackets is not None:
        rows = rows.filter(F.shiftright(column, 64 - parent_bits).isin(brackets))
    return (
        rows.groupBy(F.shiftright(column, 64 - bits).alias("bin"))
        .agg(F.sum("size").alias("bytes"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        .collect()
    )


def _settle(rows: DataFrame, column: str, base: int, targets: dict[int, tuple[float, float]], bits: int, step: int):
    """Positions for the targets: {target: (edge, bytes below)} or, where one key value straddles it,
    {target: (value, bytes below, bytes of the value)}. ``base``: bytes below all rows."""
    found: dict[int, tuple] = {}
    open_bins: dict[int, list[int]] = {0: list(targets)}
    below = {0: base}
    parent = 0
    while open_bins:
        width = bits if parent == 0 else min(64, parent + step)
        bins = _counted(rows, column, width, list(open_bins) if parent else None, parent)
        by_parent: dict[int, list] = {}
        for b in bins:
            by_parent.setdefault(b["bin"] >> (width - parent) if parent else 0, []).append(b)
        next_open: dict[int, list[int]] = {}
        next_below: dict[int, int] = {}
        for p, wanted in open_bins.items():
            inside = sorted(by_parent[p], key=lambda b: b["bin"])
            sums = below[p] + np.cumsum([b["bytes"] for b in inside])
            for i in wanted:
                goal, slack = targets[i]
                k = min(int(np.searchsorted(sums, goal)), len(inside) - 1)
                lower, upper = int(sums[k]) - inside[k]["bytes"], int(sums[k])
                b = inside[k]
                if min(goal - lower, upper - goal) <= slack:
                    edge = b["lo"] if goal - lower <= upper - goal else min(b["hi"] + 1, HIGH)
                    found[i] = (edge, lower if goal - lower <= upper - goal else upper)
                elif b["lo"] == b["hi"]:
                    found[i] = (b["lo"], lower, b["bytes"])
                else:
                    next_open.setdefault(b["bin"], []).append(i)
                    next_below[b["bin"]] = lower
        open_bins, below, parent = next_open, next_below, width
    return found


def splitters(
    rows: DataFrame, shards: int, cells: int = 8, tolerance: float = 0.002, keep_whole: float = 0.5,
    bits: int = 12, step: int = 8,
) -> list[tuple[int, int]]:
    """Cell boundaries (key, tie) over ``rows(key, tie, size)``; every ``cells``-th is a shard boundary.

    A boundary moves to the nearer edge of a group of equal keys while the group holds at most
    ``keep_whole`` of a shard's bytes; a larger group is cut by its ties. Collected per round: at most
    2**bits, then shards x cells x 2**step counters.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    count = shards * cells
    shard_bytes = total / shards
    targets = {
        i: (total * i / count, tolerance * shard_bytes if i % cells == 0 else 0.1 * shard_bytes / cells)
        for i in range(1, count)
    }
    out: dict[int, tuple[int, int]] = {}
    hot: dict[int, dict[int, tuple[float, float]]] = {}
    base: dict[int, int] = {}
    for i, spot in _settle(rows, "key", 0, targets, bits, step).items():
        if len(spot) == 2:
            out[i] = (spot[0], LOW)
            continue
        key, lower, held = spot
        goal = targets[i][0]
        if held <= keep_whole * shard_bytes:
            out[i] = (key, LOW) if goal - lower <= lower + held - goal else (min(key + 1, HIGH), LOW)
        else:
            hot.setdefault(key, {})[i] = targets[i]
            base[key] = lower
    for key, wanted in hot.items():  # fewer than shards / keep_whole keys can be that large
        inside = rows.filter(F.col("key") == key)
        for i, spot in _settle(inside, "tie", base[key], wanted, bits, step).items():
            if len(spot) == 2:
                out[i] = (key, spot[0])
            else:
                tie, lower, held = spot
                goal = wanted[i][0]
                out[i] = (key, tie) if goal - lower <= lower + held - goal else (key, min(tie + 1, HIGH))
    edges, last = [], (LOW, LOW)
    for i in range(1, count):
        last = max(last, out[i])
        edges.append(last)
    return edges


def _cell_of(edges: list[tuple[int, int]]):
    keys = np.array([k for k, _ in edges], dtype=np.int64)
    ties = np.array([t for _, t in edges], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def cell(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        at = lo.copy()
        for first in np.unique(lo[lo < hi]):
            here = (lo == first) & (lo < hi)
            at[here] = first + np.searchsorted(ties[first : hi[here][0]], t[here], "right")
        return pd.Series(at.astype(np.int32))

    return cell


@guarded("_key", "_tie", "_cell", "_start", "_at")
def shard(docs: DataFrame, shards: int = 24, cells: int = 8, tolerance: float = 0.002, keep_whole: float = 0.5) -> DataFrame:
    """All rows with ``size``, ``text_crc32``, ``shard`` (0 ..) and gapless ``slot`` in the shard's key order.

    Shards hold nearly equal bytes. Rows of equal text share a shard unless the group alone exceeds
    ``keep_whole`` of a shard. A null text counts as its own group and 8 bytes; rows equal in text and doc_id
    are one indivisible position; an empty table gives an empty result. Input columns named like an output
    column are replaced, other extra columns stay.
    """
    names = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    keyed = docs.select(
        *names,
        byte_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("_key"),
        F.xxhash64("doc_id").alias("_tie"),
    )
    slim = cut_lineage(keyed.select(F.col("_key").alias("key"), F.col("_tie").alias("tie"), "size"))
    edges = splitters(slim, shards, cells, tolerance, keep_whole)
    cell = _cell_of(edges)
    counts = dict(slim.groupBy(cell("key", "tie").alias("cell")).count().collect())
    starts, rows = [], docs.sparkSession
    for c in range(shards * cells):
        at = 0 if c % cells == 0 else starts[-1][1] + counts.get(c - 1, 0)
        starts.append((c, at))
    offsets = F.broadcast(rows.createDataFrame(starts, "_cell int, _start long"))  # one row per cell
    order = Window.partitionBy("_cell").orderBy("_key", "_tie", "doc_id", "text_crc32")
    placed = keyed.withColumn("_cell", cell("_key", "_tie")).withColumn("_at", F.row_number().over(order) - 1)
    return placed.join(offsets, "_cell").select(
        *names,
        "size",
        "text_crc32",
        F.floor(F.col("_cell") / cells).cast("int").alias("shard"),
        (F.col("_start") + F.col("_at")).alias("slot"),
    )
