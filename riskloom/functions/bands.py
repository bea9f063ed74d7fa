"""Banding and derived clinical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def right_closed_bands(
    value: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None,
    include_lowest: bool = False,
) -> Column:
    """Label of the band ``(edge_i, edge_i+1]``; null outside all bands."""
    value = _col(value)
    labels = labels or [f"bin_{i}" for i in range(len(edges) - 1)]
    expr = None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        above = value >= low if i == 0 and include_lowest else value > low
        inside = above & (value <= high)
        expr = F.when(inside, labels[i]) if expr is None else expr.when(inside, labels[i])
    return expr


def age_band(age: str | Column) -> Column:
    edges = [0, 50, 60, 70, 80, 120]
    return right_closed_bands(age, edges, [f"({a},{b}]" for a, b in zip(edges, edges[1:])])


def age_group(age: str | Column) -> Column:
    age = _col(age)
    return (
        F.when((age >= 18) & (age <= 64), "18-64")
        .when((age >= 65) & (age <= 74), "65-74")
        .when((age >= 75) & (age <= 120), ">=75")
    )


def risk_stratum(probability: str | Column) -> Column:
    p = _col(probability)
    return F.when(p < 0.1, "Low").when(p < 0.3, "Moderate").when(p.isNotNull(), "High")


def body_mass_index(weight_kg, height_cm) -> Column:
    metres = _col(height_cm) / F.lit(100.0)
    return F.try_divide(_col(weight_kg), metres * metres)


def mean_arterial_pressure(systolic, diastolic) -> Column:
    return (_col(systolic) + 2 * _col(diastolic)) / F.lit(3.0)


def pulse_pressure(systolic, diastolic) -> Column:
    return _col(systolic) - _col(diastolic)


def shock_index(heart_rate, systolic) -> Column:
    return F.try_divide(_col(heart_rate), _col(systolic))


def anaemia(haemoglobin, sex, male: str = "masculino") -> Column:
    """Haemoglobin (g/dL) below 13 in men, below 12 otherwise."""
    limit = F.when(_col(sex) == male, 13.0).otherwise(F.lit(12.0))
    return (_col(haemoglobin) < limit).cast("int")


def kidney_stage(gfr) -> Column:
    """Stage from the filtration rate."""
    g = _col(gfr)
    return (
        F.when(g >= 90, "G1").when(g >= 60, "G2").when(g >= 45, "G3a").when(g >= 30, "G3b")
        .when(g >= 15, "G4").when(g.isNotNull(), "G5")
    )
