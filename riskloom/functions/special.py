"""Distribution tails as plain functions of floats (normal, chi-square, t, F)."""

from __future__ import annotations

import math

_TINY = 1e-300


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or _TINY)
        c = (b + an / c) or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_lower(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + num * d) or _TINY)
            c = (1 + num / c) or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def chi2_upper(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def t_two_sided(t: float, dof: float) -> float:
    if dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return beta_lower(dof / (dof + t * t), dof / 2, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_lower(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_quantile(p: float, dof: float) -> float:
    """t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, dof) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_two_sided(mid, dof) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
