"""Evidence about points, as operators of their own: predecessors, successors, safe inliers, layers, dense cells, merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panewise.config import QuerySet
from panewise.functions.distance import cell, cells, combinations, dense_side, touched, widths
from panewise.plans import counting as C

#: Points that search at once, and pairs that are held at once.
ASKING, BLOCK = 1 << 16, 1 << 20


def neighbour_pairs(points: DataFrame, q: QuerySet) -> DataFrame:
    """(id, arrival, other, other_arrival, distance, layer) of all pairs within the largest range that some window may hold."""
    found = C.pairs(C.with_panes(points, q), q)
    return found.withColumn("layer", C.layer(F.col("distance"), q)).select("id", "arrival", "other", "other_arrival", "distance", "layer")


def _older() -> Column:
    return (F.col("other_arrival") < F.col("arrival")) | (F.col("other_arrival") == F.col("arrival")) & (F.col("other") < F.col("id"))


def latest_predecessors(points: DataFrame, q: QuerySet, k: int | None = None) -> DataFrame:
    """(id, rank, other, other_arrival): the k latest neighbours that came before each point (the largest k of the queries).

    Points meet by cell and time, as in counting.pairs(). Each goes back in time through those that came before it, and stops
    when it has k neighbours, so that crowded regions cost no more than others. Points of unequal or great width make all pairs.
    """
    k, (low, high) = k or q.ks[-1], widths(points)
    if low == high and 0 < low <= C.AXES:
        return _latest(points, q, k, low)
    order = Window.partitionBy("id").orderBy(F.desc("other_arrival"), F.desc("other"))
    rows = neighbour_pairs(points, q).where(_older()).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= k).select("id", "rank", "other", "other_arrival")


def _latest(points: DataFrame, q: QuerySet, k: int, width: int) -> DataFrame:
    panes, r, place = q.max_window // q.pane, q.max_range, F.col("value")
    keys, bucket = ["_bucket", *[f"_c{i}" for i in range(width)]], F.floor(F.col("pane") / panes).cast("long")
    near = {"_bucket": F.array(bucket, bucket + 1), **{f"_c{i}": c for i, c in enumerate(touched(place, r, width))}}
    own = bucket == F.col("_k._bucket")
    for i, c in enumerate(cells(place, r, width)):
        own = own & (c == F.col(f"_k._c{i}"))
    rows = C.with_panes(points, q).where("id is not null and pane is not null").withColumn("_k", F.explode(combinations(near)))
    rows = rows.select("id", "arrival", "pane", own.alias("own"), *[F.col("value")[i].alias(f"v{i}") for i in range(width)], *[F.col(f"_k.{c}").alias(c) for c in keys])

    def run(table: pd.DataFrame) -> pd.DataFrame:
        ids, arrival = table["id"].to_numpy(), table["arrival"].to_numpy()
        order = np.lexsort((ids, arrival))
        ids, arrival, pane, own = ids[order], arrival[order], table["pane"].to_numpy()[order], table["own"].to_numpy()[order]
        value = table[[f"v{i}" for i in range(width)]].to_numpy(dtype=float)[order]
        found = [x for n in range(0, own.sum(), ASKING) for x in back(ids, np.searchsorted(pane, pane - panes + 1), value, np.flatnonzero(own)[n : n + ASKING])]
        who, other, rank = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 3
        return pd.DataFrame({"id": ids[who], "rank": rank, "other": ids[other], "other_arrival": arrival[other]})

    def back(ids: np.ndarray, first: np.ndarray, value: np.ndarray, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, place of a neighbour, rank): so many places back at a time, down to the first of the oldest pane."""
        at, has, step = asking - 1, np.zeros(len(asking), dtype=np.int64), 8
        while len(asking):
            places = at[:, None] - np.arange(step)
            seen = places >= first[asking][:, None]
            places = np.maximum(places, 0)
            total = np.zeros(places.shape)
            for i in range(width):
                total += (value[asking, i][:, None] - value[places, i]) ** 2
            near = seen & (np.sqrt(total) <= r) & (ids[asking][:, None] != ids[places])
            rank = has[:, None] + np.cumsum(near, axis=1)
            taken = near & (rank <= k)
            yield np.broadcast_to(asking[:, None], places.shape)[taken], places[taken], rank[taken]
            has, at = rank[:, -1], at - step
            more = (has < k) & (at >= first[asking])
            asking, at, has = asking[more], at[more], has[more]
            step = int(max(8, min(2 * step, BLOCK // max(1, len(asking)))))

    return C.spread(rows, *keys).groupBy(*keys).applyInPandas(run, "id long, rank int, other long, other_arrival long")


def safe_inliers(points: DataFrame, q: QuerySet) -> DataFrame:
    """(id, successors): points with the largest k or more later neighbours within the smallest range and shortest window.

    Later neighbours expire after the point, so that it can never become an outlier again once they are there.
    """
    within = (F.col("distance") <= q.ranges[0]) & (F.col("other_arrival") - F.col("arrival") < q.windows[0])
    rows = neighbour_pairs(points, q).where(~_older() & within)
    return rows.groupBy("id").agg(F.count("*").alias("successors")).where(F.col("successors") >= q.ks[-1])


def dense_cells(points: DataFrame, q: QuerySet) -> DataFrame:
    """(window_end, cell, points): cells any two points of which are neighbours, with more than the largest k points in the shortest window."""
    width = widths(points)[0]
    panes = C.with_panes(points, q).select(cell("value", dense_side(q.ranges[0], width), width).alias("cell"), "pane")
    cells = panes.groupBy("cell", "pane").agg(F.count("*").alias("n"))
    rows = cells.withColumn("window_end", F.explode(C.ends(F.col("pane"), F.col("pane"), q, q.windows[0]))).where(C.due(q))
    return rows.groupBy("window_end", "cell").agg(F.sum("n").alias("points")).where(F.col("points") > q.ks[-1]).select("window_end", "cell", "points")


def merged(evidence: DataFrame) -> DataFrame:
    """(id, pane, other_pane, layer, n) of partial counts from several partitions: copies of a point become one."""
    return evidence.groupBy("id", "pane", "other_pane", "layer").agg(F.sum("n").alias("n"))


def window_grid(points: DataFrame, q: QuerySet) -> DataFrame:
    """(w, window_end, points): the sliding windows that hold points, with their number, at every due end."""
    panes = C.with_panes(points, q).groupBy("pane").agg(F.count("*").alias("n"))
    return C.in_windows(panes, q, "pane", "pane").groupBy("w", "window_end").agg(F.sum("n").alias("points"))


def report_schedule(points: DataFrame, q: QuerySet) -> DataFrame:
    """(window_end, s): which slides report at which window ends."""
    slides = F.filter(F.array(*[F.lit(s).cast("long") for s in q.slides]), lambda s: F.col("window_end") % s == 0)
    return window_grid(points, q).select("window_end").distinct().withColumn("s", F.explode(slides))
