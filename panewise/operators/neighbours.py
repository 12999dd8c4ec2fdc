"""Neighbour search on points as DataFrame functions: within a range, nearest, and both.

Identity is the id; a point is not its own neighbour. Ties go by the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.errors import ConfigError
from panewise.functions.distance import cells, combinations, euclid, touched, widths
from panewise.operators.pivots import Pivots
from panewise.plans.counting import AXES, ROUNDING, distinct_ids, spread
from panewise.storage import bounded_broadcast, written

#: Queries that are broadcast at most.
QUERIES = 10_000
#: Points of a leaf, leaves at most, and rows that the tree is fitted on at most.
ROWS, MOST, SAMPLE = 2_048, 16_384, 50_000


def range_neighbours(points: DataFrame, r: float, queries: DataFrame | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """(id, other, distance) of all pairs within r, from each of the queries (all points, if not given).

    Points of more than AXES components, of the same number for all, meet by their distances to pivots.
    """
    low, high = shape or widths(points)
    axes, place, reach, more = min(low, AXES), F.col("value"), r, []
    few = queries is not None and queries.limit(QUERIES + 1).count() <= QUERIES
    here = points if queries is None else F.broadcast(queries) if few else queries
    pivots = Pivots.choose(points, r) if low == high and low > AXES else None
    if pivots and pivots.values:
        axes, place, reach, more = min(AXES, len(pivots.values)), F.col("_x"), r * (1 + ROUNDING) + 1e-12, ["_x"]
        points, here = (df.withColumn("_x", pivots.coordinates("value")) for df in (points, here))
    keys = [f"_c{i}" for i in range(axes)]
    here = here.select("id", "value", *more, F.explode(combinations(dict(zip(keys, touched(place, reach, axes))))).alias("_k")).select("id", "value", *more, *[f"_k.{k}" for k in keys])
    # A few rows make many pairs: dealt by cell to all cores, unless the queries go to every task.
    here = here if few else spread(here, *keys)
    there = points.select(F.col("id").alias("other"), F.col("value").alias("_value"), *[F.col(c).alias(f"_other{c}") for c in more], *[c.alias(k) for k, c in zip(keys, cells(place, reach, axes))])
    found = here.join(there, keys).where("id <> other")
    if more:
        found = found.where(pivots.may_be_near(F.col("_x"), F.col("_other_x"), r))
    found = found.withColumn("distance", euclid("value", "_value", low if low == high else None))
    return found.where(F.col("distance") <= r).select("id", "other", "distance")


def nearest_of(found: DataFrame, n: int) -> DataFrame:
    """(id, rank, other, distance): the n nearest of each id's rows (id, other, distance)."""
    order = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("id", "rank", "other", "distance")


def range_limit(points: DataFrame, r: float, n: int, queries: DataFrame | None = None) -> DataFrame:
    """(id, rank, other, distance): the n nearest within r.

    They are the nearest of all that lie within r, so that no other pairs need be made. Queries of a value have the same ones but
    for themselves: one is searched for, the others get its list and the one itself. Points whose ids come twice, or of unequal
    width, are searched by all pairs within r.
    """
    if len(set(widths(points))) > 1 or not distinct_ids(points):
        return nearest_of(range_neighbours(points, r, queries), n)
    points, asked = (df.where(~F.exists("value", lambda x: x.isNull() | F.isnan(x))).select("id", "value") for df in (points, points if queries is None else queries))
    one = written(asked.groupBy("value").agg(F.min("id").alias("id")), "different-queries")
    found = nearest(points, n, one).where(F.col("distance") <= r).groupBy("id").agg(F.collect_list(F.struct("distance", "other")).alias("_near"))
    itself = F.array(F.struct(F.lit(0.0).alias("distance"), F.col("id").alias("other")))
    lists = one.join(found, "id", "left").select("value", F.array_sort(F.concat(itself, F.coalesce("_near", F.array().cast(found.schema["_near"].dataType)))).alias("_near"))
    own = F.slice(F.filter("_near", lambda x: x["other"] != F.col("id")), 1, n)
    return asked.join(lists, "value").select("id", F.posexplode(own).alias("rank", "_x")).select("id", (F.col("rank") + 1).alias("rank"), "_x.other", "_x.distance")


class Leaves:
    """A kd-tree's leaves: the tree is fitted on a bounded sample, the leaves' boxes and sizes are those of all rows."""

    def __init__(self, axes: np.ndarray, cuts: np.ndarray):
        self.axes, self.cuts = axes, cuts
        self.names = np.zeros(0, dtype=np.int64)
        self.low = self.high = np.zeros((0, 1))
        self.sizes = np.zeros(0, dtype=np.int64)

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Leaves:
        """A full tree in heap order, cut at medians of the widest component; a point goes right from the cut on."""
        axes, cuts, parts = [], [], [sample]
        for _ in range(2**depth - 1):
            part = parts.pop(0)
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
            cut = float(np.median(part[:, axis])) if len(part) else 0.0
            right = part[:, axis] >= cut
            axes.append(axis)
            cuts.append(cut)
            parts += [part[~right], part[right]]
        return cls(np.array(axes, dtype=np.int64), np.array(cuts))

    def of(self, values: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(values), dtype=np.int64)
        while len(self.axes) and len(at) and at[0] < len(self.axes):
            at = 2 * at + 1 + (values[np.arange(len(at)), self.axes[at]] >= self.cuts[at])
        return at - len(self.axes)

    def near(self, value: np.ndarray, worst: float, n: int, whole: bool) -> list[int]:
        """Leaves that may hold one of the n nearest of a point, other than itself, none of which is farther than `worst`.

        whole: all components are in the boxes, so that the leaves whose far corners are nearest bound the distance too.
        """
        below = np.maximum(np.maximum(self.low - value, value - self.high), 0)
        least = np.sqrt((below**2).sum(axis=1))
        if whole:
            most = np.sqrt((np.maximum(np.abs(self.low - value), np.abs(self.high - value)) ** 2).sum(axis=1))
            order = np.argsort(most)
            enough = np.searchsorted(np.cumsum(self.sizes[order]), n + 1)
            worst = min(worst, most[order[enough]] if enough < len(order) else np.inf)
        return self.names[least <= worst * (1 + 1e-9)].tolist()


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.array([list(v[:width]) for v in values], dtype=float).reshape(-1, width)


def leaves_of(points: DataFrame, width: int, rows: int) -> Leaves:
    """Leaves of about ROWS of the points, by their first components."""
    depth = min(MOST.bit_length() - 1, max(0, math.ceil(math.log2(max(rows, 1) / ROWS))))
    sample = points.select("value").orderBy(F.xxhash64("value", "id")).limit(SAMPLE).toPandas()["value"]
    return Leaves.fit(_matrix(sample, width), depth)


def nearest(points: DataFrame, n: int, queries: DataFrame | None = None) -> DataFrame:
    """(id, rank, other, distance): the n nearest of all points, exactly, in two rounds over the leaves of a tree.

    First each query searches its own leaf. Its n-th distance there (or, if that is nearer, the far corners of the nearest
    leaves with enough points) bounds which other leaves it must see; these it searches in the second round. Of points with
    equal values the n + 1 with the smallest ids are searched: more can never be needed.
    """
    if n < 1:
        raise ConfigError("n must be positive")
    low, high = widths(points)
    place = F.row_number().over(Window.partitionBy("value").orderBy("id"))
    few = points.select("id", "value").withColumn("_n", place).where(F.col("_n") <= n + 1).drop("_n")
    few = written(few, "nearest-points")
    tree = leaves_of(few, low, few.count())

    @F.pandas_udf("long")
    def leaf(values: pd.Series) -> pd.Series:
        return pd.Series(tree.of(_matrix(values, low)))

    few = written(few.withColumn("leaf", leaf("value")), "nearest-leaves")
    ends = [f(F.col("value")[i]).alias(f"{name}{i}") for i in range(low) for name, f in (("low", F.min), ("high", F.max))]
    boxes = few.groupBy("leaf").agg(F.count("*").alias("size"), *ends).toPandas()
    tree.names, tree.sizes = boxes["leaf"].to_numpy(), boxes["size"].to_numpy()
    tree.low, tree.high = (boxes[[f"{name}{i}" for i in range(low)]].to_numpy(dtype=float) for name in ("low", "high"))
    asked = (points if queries is None else queries).select("id", "value").withColumn("leaf", leaf("value"))
    there = few.select(F.col("id").alias("other"), F.col("value").alias("_value"), "leaf")

    def searched(rows: DataFrame) -> DataFrame:
        found = rows.join(there, "leaf").where("id <> other")
        return nearest_of(found.withColumn("distance", euclid("value", "_value", low if low == high else None)).select("id", "other", "distance"), n)

    first = written(searched(bounded_broadcast(asked, 10_000)), "nearest-first")
    worst = first.where(F.col("rank") == n).select("id", F.col("distance").alias("worst"))

    @F.pandas_udf("array<long>")
    def others(values: pd.Series, own: pd.Series, worst: pd.Series) -> pd.Series:
        found = zip(_matrix(values, low), own, worst.fillna(np.inf))
        return pd.Series([[x for x in tree.near(v, w, n, low == high) if x != o] for v, o, w in found])

    again = asked.join(worst, "id", "left").select("id", "value", F.explode(others("value", "leaf", "worst")).alias("leaf"))
    second = searched(bounded_broadcast(written(again, "nearest-asked"), 100_000))
    return nearest_of(first.select("id", "other", "distance").unionByName(second.select("id", "other", "distance")), n)
