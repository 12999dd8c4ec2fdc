"""Pivots: points of many components meet by their distances to a few of them.

By the triangle inequality, distances of two neighbours to any pivot differ by their range at most. So the distances to the first pivots
are the coordinates of a grid, in which neighbours lie in the same cell or the next, and those to all pivots rule most other
pairs out before their own distance is taken. No neighbour is lost. Pivots are drawn from a bounded sample, far from each
other; any choice gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.functions.distance import SLACK, euclid

#: Rows of the sample at most, and pivots. These bound what the driver holds.
SAMPLE, PIVOTS = 2_000, 12
#: Relative error of a distance that sums thousands of components.
ROUNDING = 1e-7


@dataclass(frozen=True)
class Pivots:
    """Chosen points, the most selective first."""

    values: tuple[tuple[float, ...], ...]

    @classmethod
    def choose(cls, points: DataFrame, r: float) -> Pivots:
        """Of the values with the smallest hashes those that are farthest from each other, ordered by how few pairs they leave within r."""
        rows = points.select("value").where(~F.exists("value", lambda x: x.isNull() | F.isnan(x))).orderBy(F.xxhash64("value")).limit(SAMPLE).collect()
        sample = np.unique(np.array([list(v["value"]) for v in rows], dtype=float), axis=0) if rows else np.zeros((0, 1))
        if not len(sample):
            return cls(())
        chosen, far = [], np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1))
        distances = []
        for _ in range(min(PIVOTS, len(sample))):
            chosen.append(int(far.argmax()))
            distances.append(np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(axis=1)))
            far = np.minimum(far if len(chosen) > 1 else np.inf, distances[-1])
        left = []
        for d in distances:
            x = np.sort(d)
            left.append(float((np.searchsorted(x, x + r, "right") - np.arange(len(x))).mean()))
        return cls(tuple(tuple(sample[chosen[i]].tolist()) for i in np.argsort(left, kind="stable")))

    def coordinates(self, value: str | Column) -> Column:
        """Array of the distances to the pivots."""
        return F.array(*[euclid(F.col(value) if isinstance(value, str) else value, F.lit(list(p))) for p in self.values])

    def may_be_near(self, a: Column, b: Column, r: float) -> Column:
        """Whether no pivot rules a pair out, from the coordinates of both."""
        reach = r * (1 + SLACK)
        out = F.lit(True)
        for i in range(len(self.values)):
            out = out & (F.abs(a[i] - b[i]) <= reach + ROUNDING * (a[i] + b[i]))
        return out
