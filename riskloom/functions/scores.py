"""Clinical point scores as column expressions: no fit, no shuffle, usable on a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fv


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def points_if(condition: Column, points: int = 1) -> Column:
    """``points`` where the condition holds; false and unknown both give 0."""
    return F.when(condition, points).otherwise(F.lit(0))


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def decimal_comma(c: str | Column) -> Column:
    """Text such as ``12,5`` to double; unreadable text to null."""
    return F.regexp_replace(_col(c).cast("string"), ",", ".").try_cast("double")


def range_points(value: str | Column, table: Sequence[tuple], contiguous: bool = False) -> Column:
    """Points of the range holding the value, 0 outside.

    By default a range is ``[low, high)`` as printed, so that values on ``high`` score 0.
    ``contiguous=True`` closes the gaps by using the next range's low end instead.
    """
    value = _col(value)
    expr = None
    for i, (low, high, points) in enumerate(table):
        end = table[i + 1][0] if contiguous and i + 1 < len(table) else high
        inside = (value >= low) & (value < end)
        expr = F.when(inside, points) if expr is None else expr.when(inside, points)
    return expr.otherwise(F.lit(0))


def three_bands(score: Column, bounds: tuple) -> Column:
    return (
        F.when(score <= bounds[0], "low").when(score <= bounds[1], "intermediate").otherwise("high")
    )


def killip_number(c: str | Column) -> Column:
    """Killip class from Roman or Arabic text, null when it is neither."""
    text = F.upper(F.trim(_col(c).cast("string")))
    expr = None
    for number, names in enumerate((("I", "1"), ("II", "2"), ("III", "3"), ("IV", "4")), start=1):
        test = text.isin(*names)
        expr = F.when(test, number) if expr is None else expr.when(test, number)
    return expr


def grace_score(
    age: str | Column,
    heart_rate: str | Column,
    systolic: str | Column,
    creatinine: str | Column,
    arrest: Column,
    st_deviation: Column,
    enzymes: Column,
    killip: Column,
    contiguous: bool = False,
) -> Column:
    killip_points = None
    for grade, points in fv.GRACE_KILLIP.items():
        test = killip == grade
        killip_points = (
            F.when(test, points) if killip_points is None else killip_points.when(test, points)
        )
    return total(
        [
            range_points(age, fv.GRACE_AGE, contiguous),
            range_points(heart_rate, fv.GRACE_HEART_RATE, contiguous),
            range_points(systolic, fv.GRACE_SYSTOLIC, contiguous),
            range_points(creatinine, fv.GRACE_CREATININE, contiguous),
            points_if(arrest, fv.GRACE_ARREST),
            points_if(st_deviation, fv.GRACE_ST),
            points_if(enzymes, fv.GRACE_ENZYMES),
            killip_points.otherwise(F.lit(0)),
        ]
    )


def grace_band(score: Column) -> Column:
    return three_bands(score, fv.GRACE_BANDS)


def timi_simple(age, diabetes: Column, hypertension: Column, prior_mi: Column) -> Column:
    age = _col(age)
    return total(
        [
            points_if(age >= 65),
            points_if(age >= 75),
            points_if(diabetes),
            points_if(hypertension),
            points_if(prior_mi),
        ]
    )


def timi_simple_band(score: Column) -> Column:
    return three_bands(score, fv.TIMI_BANDS)


def timi_nstemi_partial(
    age, risk_factors: Sequence[Column], known_disease: Column, angina: Column, st_deviation: Column
) -> Column:
    """Partial score: aspirin is not counted and markers are taken as raised in every row."""
    return total(
        [
            points_if(_col(age) >= 65),
            points_if(total([points_if(r) for r in risk_factors]) >= 3),
            points_if(known_disease),
            points_if(angina),
            points_if(st_deviation),
            F.lit(1),
        ]
    )


def timi_stemi(
    age, diabetes: Column, hypertension: Column, systolic, heart_rate, killip: Column, weight,
    anterior: Column, minutes_to_treatment,
) -> Column:
    age = _col(age)
    return total(
        [
            F.when(age >= 75, 3).when(age >= 65, 2).otherwise(F.lit(0)),
            points_if(diabetes | hypertension),
            points_if(_col(systolic) < 100, 3),
            points_if(_col(heart_rate) > 100, 2),
            points_if(killip.isin("II", "III", "IV"), 2),
            points_if(_col(weight) < 67),
            points_if(anterior),
            points_if(_col(minutes_to_treatment) > 240),
        ]
    )


def any_positive(columns: Sequence[str]) -> Column:
    """Sum of the columns, nulls as 0, is positive."""
    return total([F.coalesce(F.col(c), F.lit(0)) for c in columns]) > 0


def leads_not_null(leads: Sequence[str] = tuple(fv.ECG_LEADS)) -> Column:
    return total([F.col(c).isNotNull().cast("int") for c in leads])


def leads_not_zero(leads: Sequence[str] = tuple(fv.ECG_LEADS)) -> Column:
    return total([points_if(F.col(c) != 0) for c in leads])


def tokens(text: str | Column) -> Column:
    """Lower-case trimmed tokens of a list in one cell; an empty array for null or blank text."""
    parts = F.split(F.lower(_col(text)), fv.TOKEN_SEPARATORS)
    trimmed = F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def has_token(token_array: Column, family: Sequence[str]) -> Column:
    return F.arrays_overlap(token_array, F.array(*[F.lit(t) for t in family]))


def registry_components(
    age, systolic, gfr, leads: Column, killip_iv: Column, vf_vt: Column, high_grade_avb: Column
) -> dict[str, Column]:
    tests = {
        "age_gt_70": _col(age) > 70,
        "sbp_lt_100": _col(systolic) < 100,
        "gfr_lt_60": _col(gfr) < 60,
        "ecg_leads_gt_7": leads > 7,
        "killip_iv": killip_iv,
        "vf_vt": vf_vt,
        "high_grade_avb": high_grade_avb,
    }
    return {name: points_if(test, fv.REGISTRY_POINTS[name]) for name, test in tests.items()}


def registry_band(score: Column, high_from: int = 4) -> Column:
    return F.when(score >= high_from, "high").otherwise("low")


def registry_probability(score: Column) -> Column:
    """Published probability per score; scores outside 0..10 are clipped first."""
    entries = [F.lit(x) for pair in fv.REGISTRY_PROBABILITY.items() for x in pair]
    clipped = F.least(F.greatest(score.cast("int"), F.lit(0)), F.lit(fv.REGISTRY_MAX))
    return F.when(score.isNotNull(), F.element_at(F.create_map(*entries), clipped))


def registry_from_tokens(
    age="edad", systolic="presion_arterial_sistolica", gfr="filtrado_glomerular",
    killip="indice_killip", complications="complicaciones", leads: Sequence[str] = fv.ECG_LEADS,
) -> dict[str, Column]:
    """Token variant: exact tokens, leads counted when recorded, Killip text ``IV`` or ``4``."""
    found = tokens(complications)
    return registry_components(
        age, systolic, gfr, leads_not_null(leads),
        F.upper(F.trim(F.col(killip).cast("string"))).isin("IV", "4"),
        has_token(found, fv.TOKENS_VF + fv.TOKENS_VT),
        has_token(found, fv.TOKENS_AVB_HIGH),
    )


def registry_from_patterns(
    age="edad", systolic="presion_arterial_sistolica", gfr="filtrado_glomerular",
    killip="indice_killip", complications="complicaciones", leads: Sequence[str] = fv.ECG_LEADS,
    killip_is_text: bool = True,
) -> dict[str, Column]:
    """Pattern variant: whole-word patterns, leads counted when non-zero, text class only ``IV``."""
    upper = F.upper(F.coalesce(F.col(complications), F.lit("")))
    killip_iv = (
        F.upper(F.trim(F.col(killip))) == "IV" if killip_is_text else F.col(killip) == 4
    )
    return registry_components(
        decimal_comma(age), decimal_comma(systolic), decimal_comma(gfr), leads_not_zero(leads),
        killip_iv, upper.rlike(fv.PATTERN_VF_VT_WORD), upper.rlike(fv.PATTERN_AVB_WORD),
    )


def registry_from_parts(
    age="edad", systolic="presion_arterial_sistolica", gfr="filtrado_glomerular",
    killip="indice_killip", complications="complicaciones", leads: Sequence[str] = fv.ECG_LEADS,
) -> dict[str, Column]:
    """Report variant: patterns match inside words, class compared as written."""
    upper = F.upper(F.coalesce(F.col(complications), F.lit("")))
    return registry_components(
        age, systolic, decimal_comma(gfr), leads_not_zero(leads), F.col(killip) == "IV",
        upper.rlike(fv.PATTERN_VF_VT_PART), upper.rlike(fv.PATTERN_AVB_PART),
    )


def complication_flags(text: str | Column = "complicaciones") -> dict[str, Column]:
    """0/1 flag per token family."""
    found = tokens(text)
    families: Mapping[str, list[str]] = {
        "comp_fv": fv.TOKENS_VF,
        "comp_tv": fv.TOKENS_VT,
        "comp_fv_tv": fv.TOKENS_VF + fv.TOKENS_VT,
        "comp_bav_alto_grado": fv.TOKENS_AVB_HIGH,
        "comp_bav_bajo_grado": fv.TOKENS_AVB_LOW,
        "comp_shock": fv.TOKENS_SHOCK,
        "comp_ic": fv.TOKENS_HEART_FAILURE,
        "comp_pcr": fv.TOKENS_ARREST,
        "comp_otras_arritmias": fv.TOKENS_OTHER_ARRHYTHMIA,
        "comp_mecanicas": fv.TOKENS_MECHANICAL,
    }
    return {name: has_token(found, family).cast("int") for name, family in families.items()}


def pseudo_probability(score: str | Column, maximum: float) -> Column:
    """Score as a share of its maximum, clipped to 0..1; a missing score stays missing."""
    share = _col(score) / F.lit(float(maximum))
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))  # these two skip nulls
    return F.when(share.isNotNull(), clipped)
