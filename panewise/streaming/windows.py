"""Detection on streams with Spark's own windows: watermark, sliding windows, and counts in append mode.

A group is a window of a partition. Points should be dealt out by a partitioner first (column partition), so that groups are
as small as the partitioner makes them; without one, a window's points come to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.config import QuerySet
from panewise.plans.counting import reported
from panewise.streaming.evidence import neighbours_by_layer


def counts_of(ids: np.ndarray, arrivals: np.ndarray, flags: np.ndarray, values: np.ndarray, end: int, q: QuerySet) -> list[int | None]:
    """Outliers of flag 0 among the points of the longest window before `end`, for each window, range and k in this order.

    A window without points has None.
    """
    out = []
    for w in q.windows:
        live = arrivals >= end - w
        if not live.any():
            out += [None] * (len(q.ranges) * len(q.ks))
            continue
        own = live & (flags == 0)
        layers, _ = neighbours_by_layer(ids[own], values[own], ids[live], values[live], q.ranges)
        found = np.cumsum(layers, axis=1)
        out += [int((found[:, j] < k).sum()) for j in range(len(q.ranges)) for k in q.ks]
    return out


def _counter(q: QuerySet) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(ids: pd.Series, arrivals: pd.Series, flags: pd.Series, flat: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([counts_of(np.asarray(i), np.asarray(a), np.asarray(f), np.asarray(v, dtype=float).reshape(len(i), -1), int(e), q) for i, a, f, v, e in zip(ids, arrivals, flags, flat, end)])

    return run


def detect_stream(points: DataFrame, q: QuerySet) -> DataFrame:
    """(window_end, R, k, w, s, outliers) of a stream (or table) of points whose values have equally many components.

    Points may come up to the slide later than the newest. A window is reported when the watermark passes its end.
    """
    parts = ["partition"] if "partition" in points.columns else []
    rows = points.withColumn("ts", F.timestamp_millis("arrival")).withWatermark("ts", f"{q.lateness} milliseconds")
    window = F.window("ts", f"{q.max_window} milliseconds", f"{q.slide} milliseconds")
    found = rows.groupBy(window, *parts).agg(F.collect_list(F.struct("id", "arrival", "flag", "value")).alias("p"))
    end = F.unix_millis("window.end")
    counted = found.select("window", _counter(q)(F.col("p.id"), F.col("p.arrival"), F.col("p.flag"), F.flatten(F.col("p.value")), end).alias("c"))
    n = len(q.ranges) * len(q.ks)
    if parts:
        sums = counted.groupBy("window").agg(*[F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(n * len(q.windows))])
    else:
        sums = counted.select("window", *[F.col("c")[j].alias(f"c{j}") for j in range(n * len(q.windows))])
    by_window = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), *[F.col(f"c{i * n + j}").alias(f"c{j}") for j in range(n)]) for i, w in enumerate(q.windows)])
    sums = sums.select(F.unix_millis("window.end").alias("window_end"), F.explode(by_window).alias("r")).select("window_end", "r.*")
    return reported(sums.where("c0 is not null"), q)


def by_window_stream(points: DataFrame, q: QuerySet, function: Callable, schema: str) -> DataFrame:
    """(window_end, R, k, w, s, outliers) of a stream by a function of (window_end, w, pandas table of points); see strategies.by_window.

    A window of the longest length is one row; the function is called for each length that has points in it.
    """
    rows = points.withColumn("ts", F.timestamp_millis("arrival")).withWatermark("ts", f"{q.lateness} milliseconds")
    window = F.window("ts", f"{q.max_window} milliseconds", f"{q.slide} milliseconds", f"{-q.max_window % q.slide} milliseconds")
    found = rows.groupBy(window).agg(F.collect_list(F.struct("id", "value", "arrival", "flag")).alias("p"))
    found = found.select(F.unix_millis("window.end").alias("window_end"), *[F.col(f"p.{c}").alias(c) for c in ("id", "value", "arrival", "flag")])

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for windows in tables:
            for end, ids, values, arrivals, flags in windows.itertuples(index=False):
                if all(end % s for s in q.slides):
                    continue
                table = pd.DataFrame({"id": ids, "value": list(values), "arrival": arrivals, "flag": flags})
                for w in q.windows:
                    live = table[table["arrival"] >= end - w].reset_index(drop=True)
                    if len(live):
                        yield function(int(end), int(w), live).assign(w=int(w), window_end=int(end))

    found = found.mapInPandas(run, f"{schema}, w long, window_end long")
    slides = F.filter(F.array(*[F.lit(s).cast("long") for s in q.slides]), lambda s: F.col("window_end") % s == 0)
    return found.withColumn("s", F.explode(slides)).select("window_end", "R", "k", "w", "s", F.col("outliers").cast("long").alias("outliers"))
