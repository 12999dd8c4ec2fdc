"""Partitioners that copy points to every partition in which a neighbour may be.

Each adds `partition` to points and gives them flag 0 in exactly one partition, their own, and flag 1 in the others. Whichever
is used, a partition holds all neighbours of its own points within the range.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.config import OutlierConfig, Partitioning
from panewise.errors import PartitioningError
from panewise.functions.distance import SLACK, euclid

MEMBERSHIP = "array<struct<partition:int,flag:int>>"


class Partitioner(ABC):
    @abstractmethod
    def memberships(self, r: float) -> Column:
        """Array of (partition, flag) of a point, from its columns id and value."""

    def partition(self, points: DataFrame, r: float) -> DataFrame:
        """points of flag 0, once for each partition; other columns stay."""
        rest = [c for c in points.columns if c not in ("partition", "flag")]
        own = points.where("flag = 0").select(*rest, F.explode(self.memberships(r)).alias("_m"))
        return own.select(*rest, "_m.partition", "_m.flag")

    def __call__(self, points: DataFrame, r: float) -> DataFrame:
        return self.partition(points, r)


@dataclass(frozen=True)
class Replication(Partitioner):
    """A copy for every partition; a point's own is its id modulo their number (never negative)."""

    partitions: int = 16

    def memberships(self, r: float) -> Column:
        own = F.pmod("id", F.lit(self.partitions))
        return F.transform(F.sequence(F.lit(0), F.lit(self.partitions - 1)), lambda p: F.struct(p.alias("partition"), F.when(p == own, 0).otherwise(1).alias("flag")))


@dataclass(frozen=True)
class Stripes(Partitioner):
    """Stripes of the first component, so many ranges wide: as many as the points need, without boundaries to be given.

    Copies go to the one neighbouring stripe that the range touches, if there is one.
    """

    ranges: int = 8

    def memberships(self, r: float) -> Column:
        stripe = lambda x: F.floor(x / (self.ranges * r)).cast("long")
        x = F.col("value")[0]
        own, reach = stripe(x), r * (1 + SLACK)
        return F.transform(F.sequence(stripe(x - reach), stripe(x + reach)), lambda p: F.struct(p.alias("partition"), F.when(p == own, 0).otherwise(1).alias("flag")))


@dataclass(frozen=True)
class Grid(Partitioner):
    """Cells between boundaries in each of the first components, numbered from `start`, the last component fastest.

    A boundary belongs to the cell above it; the outer cells have no end. Copies go to every cell that the range touches.
    """

    boundaries: tuple[tuple[float, ...], ...]
    start: int = 0

    def __post_init__(self):
        if not self.boundaries or any(list(b) != sorted(set(b)) for b in self.boundaries):
            raise PartitioningError("boundaries must rise in every component")

    @property
    def partitions(self) -> int:
        return int(np.prod([len(b) + 1 for b in self.boundaries]))

    def memberships(self, r: float) -> Column:
        own, cells = F.lit(self.start), F.array(F.lit(self.start))
        stride = self.partitions
        for axis, bounds in enumerate(self.boundaries):
            stride //= len(bounds) + 1
            below = lambda x, bounds=bounds: sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))
            x = F.col("value")[axis]
            own = own + below(x) * stride
            cells = _crossed(cells, below(x - r), below(x + r), stride)
        return F.transform(cells, lambda p: F.struct(p.alias("partition"), F.when(p == own, 0).otherwise(1).alias("flag")))


def _crossed(cells: Column, low: Column, high: Column, stride: int) -> Column:
    return F.flatten(F.transform(F.sequence(low, high), lambda i: F.transform(cells, lambda c: c + i * stride)))


#: The grids of two well-known data sets, one of stock prices and one of sea temperatures.
PRESETS = {
    "stk": Grid(((87.231, 94.222, 96.5, 97.633, 98.5, 99.25, 99.897, 100.37, 101.16, 102.13, 103.18, 104.25, 105.25, 106.65, 109.75),)),
    "tao": Grid(((-0.01,), (79.23, 82.47, 85.77), (26.932,)), start=1),
}


def preset(name: str) -> Grid | None:
    """The grid of a data set's name, in any case; None for others."""
    return PRESETS.get(name.lower())


def even_grid(points: DataFrame, r: float, partitions: int = 16) -> Grid:
    """A grid on the first component with about as many points in each cell, from approximate quantiles."""
    shares = [i / partitions for i in range(1, partitions)]
    found = points.select(F.col("value")[0].alias("x")).approxQuantile("x", shares, 0.01)
    return Grid((tuple(sorted(set(found))),))


@dataclass(frozen=True)
class VPTree(Partitioner):
    """A vantage-point tree: at each node points are near (within a radius of its vantage point) or far.

    nodes are in heap order; partition i is the i-th leaf.
    """

    nodes: tuple[tuple[tuple[float, ...], float], ...]

    @classmethod
    def fit(cls, sample: Sequence[Sequence[float]], partitions: int = 16) -> VPTree:
        """A tree for a power of two of partitions, on a bounded sample: radii are the median distances, so that halves are even."""
        if partitions < 1 or partitions & (partitions - 1):
            raise PartitioningError("a tree needs a power of two of partitions")
        if not len(sample):
            raise PartitioningError("a tree needs sample points")
        points = np.asarray(sample, dtype=float)
        nodes, todo = [], [points]
        for _ in range(partitions - 1):
            part = todo.pop(0)
            part = part if len(part) else points[:1]
            vantage = part[np.argsort(part[:, 0], kind="stable")[len(part) // 2]]
            far = np.sqrt(((part - vantage) ** 2).sum(axis=1))
            radius = float(np.median(far))
            nodes.append((tuple(map(float, vantage)), radius))
            todo += [part[far <= radius], part[far > radius]]
        return cls(tuple(nodes))

    def memberships(self, r: float) -> Column:
        distances = [euclid(F.col("value"), F.array(*[F.lit(v) for v in vantage]), len(vantage)) for vantage, _ in self.nodes]
        return F.transform(F.array(F.array(*distances) if distances else F.array().cast("array<double>")), lambda d: self._leaves(d, r))[0]

    def _leaves(self, distance: Column, r: float) -> Column:
        n, leaves = len(self.nodes), []
        for leaf in range(n + 1):
            node, own, reached = n + leaf, F.lit(True), F.lit(True)
            while node:
                node, far = (node - 1) // 2, node % 2 == 0
                d, radius = distance[node], self.nodes[node][1]
                own = own & ((d > radius) if far else (d <= radius))
                reached = reached & ((d + r > radius) if far else (d - r <= radius))
            leaves.append(F.when(own | reached, F.struct(F.lit(leaf).alias("partition"), F.when(own, 0).otherwise(1).alias("flag"))))
        return F.array_compact(F.array(*leaves))


@dataclass(frozen=True)
class ByColumn(Partitioner):
    """A user's partitioner as an expression: (id, value, range) to an array of (partition, flag)."""

    function: Callable[[Column, Column, float], Column]

    def memberships(self, r: float) -> Column:
        return self.function(F.col("id"), F.col("value"), r).cast(MEMBERSHIP)


@dataclass
class PartitioningState:
    """Collects where a user's function puts a point."""

    found: list[tuple[int, int]] = field(default_factory=list)

    def included_in(self, partition: int) -> None:
        self.found.append((int(partition), 0))

    def included_flagged_in(self, partition: int) -> None:
        self.found.append((int(partition), 1))


@dataclass(frozen=True)
class ByFunction(Partitioner):
    """A user's partitioner as a Python function of (id, value, range, PartitioningState)."""

    function: Callable[[int, Sequence[float], float, PartitioningState], Any]

    def memberships(self, r: float) -> Column:
        function = self.function

        @F.pandas_udf(MEMBERSHIP)
        def run(identity: pd.Series, value: pd.Series) -> pd.Series:
            out = []
            for i, v in zip(identity, value):
                state = PartitioningState()
                function(int(i), list(v), r, state)
                out.append([{"partition": p, "flag": f} for p, f in state.found])
            return pd.Series(out)

        return run(F.col("id"), F.col("value"))


def checked(parted: DataFrame) -> DataFrame:
    """parted, or PartitioningError if some point has not exactly one copy of flag 0."""
    bad = parted.groupBy("id").agg(F.sum(F.when(F.col("flag") == 0, 1).otherwise(0)).alias("own")).where("own <> 1").limit(1).collect()
    if bad:
        raise PartitioningError(f"point {bad[0]['id']} has {bad[0]['own']} copies of flag 0")
    return parted


def of_config(config: OutlierConfig, sample: Callable[[], Iterable[Sequence[float]]] | None = None) -> Partitioner | None:
    """The partitioner that a configuration names; None without one. sample gives a tree's sample points."""
    if config.partitioning is None:
        return None
    if config.partitioning is Partitioning.REPLICATION:
        return Replication(config.partitions)
    given = config.partitioner
    if isinstance(given, Partitioner):
        return given
    if config.partitioning is Partitioning.GRID:
        found = given if given is not None else preset(config.dataset)
        return found if isinstance(found, Partitioner) or found is None else ByFunction(found)
    if config.partitioning is Partitioning.TREE:
        if sample is None:
            raise PartitioningError("a tree needs sample points")
        return VPTree.fit(list(sample()), config.partitions)
    return ByFunction(given)
