"""Linear support vector classifier over random Fourier features that no table holds.

A row is its few coordinates and its label; its features are worked out again in every pass, in NumPy blocks inside the
tasks, as a wide table of them would be a hundred times the rows. A pass sums loss and gradient per task, Spark adds them
up, and the driver holds a few vectors as long as the features.

Loss, scaling and steps are those of Spark's ``LinearSVC`` without standardisation, which keeps all features in its
blocks: weighted mean hinge loss plus ``regParam`` / 2 times the squared weights, solved over scaled and centred features
by quasi-Newton steps (ten pairs kept) that are projected on the orthant, with a backtracking search for strong Wolfe conditions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 1 << 14  # cells of a block of features: it stays in a core's cache
# sin(2 pi b) / b as a polynomial of b^2 up to a quarter turn, right to the last digits: several times faster than NumPy's cosine
_SINE = np.polynomial.Chebyshev.interpolate(lambda s: 2 * np.pi * np.sinc(2 * np.sqrt(s)), 8, [0, 1 / 16]).convert(kind=np.polynomial.Polynomial).coef
_PAIRS = 10


@dataclass
class FourierMap:
    """Random Fourier features: inner products approach exp(-|x - y|^2 / (columns * variance)); drawn from the seed."""

    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def drawn(cls, columns: int, variance: float, features: int, seed: int) -> FourierMap:
        draw = np.random.default_rng(seed)
        gamma = 1.0 / (columns * variance) if variance > 0 else 1.0
        directions = draw.normal(0.0, np.sqrt(2 * gamma), (columns, features))
        return cls(directions, draw.uniform(0.0, 2 * np.pi, features))

    @property
    def width(self) -> int:
        return len(self.phases)

    def blocks(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(rows, their features) block by block; a block's array is used again for the next one."""
        turns = np.vstack([self.directions, self.phases]) / (2 * np.pi)
        top, *lower = reversed(_SINE * math.sqrt(2.0 / self.width))
        x = np.column_stack([x, np.ones(len(x))])
        step = max(1, _BLOCK // self.width)
        angle, square, value = (np.empty((min(step, len(x)), self.width)) for _ in range(3))
        for start in range(0, len(x), step):
            part = x[start : start + step]
            a, s, v = angle[: len(part)], square[: len(part)], value[: len(part)]
            np.matmul(part, turns, out=a)
            a -= np.rint(a, out=s)
            np.abs(a, out=a)
            np.subtract(0.25, a, out=a)  # the cosine is the sine of a quarter turn less
            np.multiply(a, a, out=s)
            np.multiply(s, top, out=v)
            for c in lower[:-1]:
                v += c
                v *= s
            v += lower[-1]
            v *= a
            yield slice(start, start + len(part)), v


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]).astype(float)


def _summed(rows: DataFrame, columns: list[str], part: Callable, size: int) -> np.ndarray:
    """The vector of ``size`` sums that ``part(x, y, w)`` gives, added up over all rows."""
    width = len(columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in (b for b in batches if b.num_rows):
            y, w = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(2))
            total += part(_matrix(batch, width), y, w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    parts = rows.select(*[F.col(c).cast("double") for c in columns], "_label", "_w").mapInArrow(add, "i int, v double")
    found = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    if not np.isfinite(out).all():
        raise ValueError("coordinates must be finite numbers")
    return out


def fit_margin(
    rows: DataFrame, columns: list[str], fourier: FourierMap, reg_param: float, max_iter: int = 100, tol: float = 1e-6
) -> tuple[np.ndarray, float]:
    """Weights and intercept; ``rows`` have the columns, ``_label`` (0 or 1) and the weight ``_w``."""
    n = fourier.width

    def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * n + 2)
        for at, z in fourier.blocks(x):
            out[:n] += w[at] @ z
            out[n : 2 * n] += w[at] @ (z * z)
        out[2 * n :] = w.sum(), (w * w).sum()
        return out

    found = _summed(rows, columns, moments, 2 * n + 2)
    total, squares = found[2 * n :]
    mean = found[:n] / total
    spread = np.sqrt(np.maximum(found[n : 2 * n] - total * mean * mean, 0.0) / (total - squares / total))
    inverse = np.divide(1.0, spread, out=np.zeros(n), where=spread > 0)
    centre = mean * inverse

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, shift = at[:n] * inverse, at[n] - at[:n] @ centre

        def hinge(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            out, side = np.zeros(n + 2), 2 * y - 1
            for rows_at, z in fourier.blocks(x):
                gap = 1 - side[rows_at] * (z @ scaled + shift)
                pull = np.where(gap > 0, -side[rows_at] * w[rows_at], 0.0)
                out[:n] += pull @ z
                out[n] += pull.sum()
                out[n + 1] += w[rows_at] @ np.maximum(gap, 0.0)
            return out

        sums = _summed(rows, columns, hinge, n + 2) / total
        penalty = reg_param * at[:n] * inverse * inverse
        gradient = np.append(sums[:n] * inverse - centre * sums[n] + penalty, sums[n])
        return sums[n + 1] + 0.5 * at[:n] @ penalty, gradient

    best = minimised(loss, np.zeros(n + 1), max_iter, tol)
    return best[:n] * inverse, float(best[n] - best[:n] @ centre)


class _StepFailed(ArithmeticError):
    pass


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton direction from (step, change of gradient) pairs, the newest first; never against the gradient's sign."""
    out, used = gradient.copy(), []
    for step, change in pairs:
        share = (step @ out) / (step @ change)
        if math.isnan(share):
            raise _StepFailed
        used.append(share)
        out -= share * change
    if pairs:
        step, change = pairs[0]
        if not step @ change >= 0:
            raise _StepFailed
        out *= (step @ change) / (change @ change)
    for (step, change), share in zip(reversed(pairs), reversed(used)):
        out += (share - (change @ out) / (step @ change)) * step
    return np.where(-out * gradient < 0, -out, 0.0)


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Where ``loss`` (value and gradient) is least, as far as ``max_iter`` steps or the tolerance of the last 20 values go."""
    value, gradient = loss(x)
    first, values, pairs, turn, failed = abs(value), [math.inf], [], 0, False
    while turn < max_iter:
        if len(values) > 1 and abs(value - max(values)) <= tol * first or np.linalg.norm(gradient) <= max(tol * value, 1e-8):
            break
        orthant = np.where(x != 0, np.sign(x), np.sign(-gradient))

        def moved(alpha: float) -> tuple[np.ndarray, float, np.ndarray]:
            new = x + alpha * way
            new = np.where(np.sign(new) == orthant, new, 0.0)
            return new, *loss(new)

        try:
            way = _direction(gradient, pairs)
            new, new_value, new_gradient = _searched(moved, value, gradient @ way, way, 0.1 if turn < 1 else 0.5, 0.5 / np.linalg.norm(gradient) if turn < 1 else 1.0)
        except _StepFailed:
            if failed:
                break
            pairs, failed = [], True
            continue
        pairs = [(new - x, new_gradient - gradient), *pairs][:_PAIRS]
        x, value, gradient, turn, failed = new, new_value, new_gradient, turn + 1, False
        values = [*values, value][-20:]
    return x


def _searched(moved: Callable, value: float, slope: float, way: np.ndarray, shrink: float, alpha: float) -> tuple[np.ndarray, float, np.ndarray]:
    """The first step along ``way`` that lowers the value enough and flattens the slope enough; 19 changes of its length at most.

    As in Spark's solver the first length is judged by the starting value, so it is always shortened and never tried.
    """
    changes = 19
    if value > value + alpha * slope * 1e-4:
        alpha, changes = alpha * shrink, 18
    found = moved(alpha)
    for _ in range(changes):
        rise = found[2] @ way
        if found[1] > value + alpha * slope * 1e-4:
            alpha *= shrink
        elif rise < 0.9 * slope:
            alpha *= 2.1
        elif rise > -0.9 * slope:
            alpha *= shrink
        else:
            break
        if not 1e-10 <= alpha <= 1e10:
            raise _StepFailed
        found = moved(alpha)
    return found


def margin_column(columns: list[str], fourier: FourierMap, weights: np.ndarray, intercept: float) -> Column:
    """Signed distance of a row to the classifier's border, in units of its margin."""

    @F.pandas_udf("double")
    def of(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        out = np.zeros(len(x))
        for at, z in fourier.blocks(x):
            out[at] = z @ weights + intercept
        return pd.Series(out)

    return of(*[F.col(c).cast("double") for c in columns])
