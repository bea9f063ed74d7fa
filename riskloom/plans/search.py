"""Parameter search by density ratios: small driver-side bookkeeping; the trials are Spark jobs.

After some random trials the finished ones are split into the good (a quarter of the root of their number) and the
others. Each parameter has a Parzen density over the good values and one over the others; candidates are drawn from the
good density and the one with the largest ratio is tried next. A trial is stopped at a fold when its running mean is below the median of the running
means that earlier trials had there.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from statistics import median

# The forest's search space (a depth of 30 stands for no bound, `all` for all features)
FOREST_SPACE = {
    "numTrees": list(range(200, 901, 50)),
    "maxDepth": [30, *range(2, 30)],
    "minInstancesPerNode": list(range(1, 11)),
    "featureSubsetStrategy": ["sqrt", "log2", "all", "0.5", "0.8"],
    "bootstrap": [True, False],
    "balancing": ["none", "class_weight"],
}


def _is_ordered(values: Sequence) -> bool:
    return len(values) > 2 and all(isinstance(v, int | float) and not isinstance(v, bool) for v in values) and list(values) == sorted(values)


class ParzenSearch:
    """Proposes points of ``space`` (parameter: its values; rising numbers are ordered, others are categories)."""

    def __init__(self, space: Mapping[str, Sequence], seed: int = 42, startup: int = 10, candidates: int = 24, patience: int = 5):
        self.space, self.startup, self.candidates, self.patience = {n: list(v) for n, v in space.items()}, startup, candidates, patience
        self.random = random.Random(seed)
        self.trials: list[tuple[dict, list[float]]] = []

    def propose(self) -> dict:
        if len(self.trials) < self.startup:
            return {n: self.random.choice(v) for n, v in self.space.items()}
        # stopped trials rank by their last running mean, behind those that went further
        order = sorted(self.trials, key=lambda t: (-len(t[1]), -sum(t[1]) / len(t[1])))
        good = math.ceil(0.25 * math.sqrt(len(order)))
        return {n: self._best_value(v, [p[n] for p, _ in order[:good]], [p[n] for p, _ in order[good:]]) for n, v in self.space.items()}

    def _best_value(self, values: list, good: list, others: list):
        near, far = self._density(values, good), self._density(values, others)
        drawn = self.random.choices(range(len(values)), near, k=self.candidates)
        return values[max(dict.fromkeys(drawn), key=lambda i: near[i] / far[i])]

    def _density(self, values: list, seen: list) -> list[float]:
        """Share of every value: a wide prior and one kernel around each seen value."""
        n = len(values)
        total = [1.0 / n] * n
        width = max(1.0, 0.1 * n)
        for s in seen:
            at = values.index(s)
            kernel = [math.exp(-0.5 * ((i - at) / width) ** 2) for i in range(n)] if _is_ordered(values) else [float(i == at) for i in range(n)]
            size = sum(kernel)
            total = [t + x / size for t, x in zip(total, kernel)]
        size = sum(total)
        return [t / size for t in total]

    def stops(self, found: Sequence[float]) -> bool:
        step = len(found)
        earlier = [sum(f[:step]) / step for _, f in self.trials if len(f) >= step]
        return len(self.trials) >= self.patience and bool(earlier) and sum(found) / step < median(earlier)

    def record(self, point: dict, found: Sequence[float]) -> None:
        self.trials.append((dict(point), list(found)))

    def best(self, full: int) -> dict:
        """The point of the best mean among the trials that were measured in full."""
        done = [t for t in self.trials if len(t[1]) >= full] or self.trials
        return max(done, key=lambda t: sum(t[1]) / len(t[1]))[0]
