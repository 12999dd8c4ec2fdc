"""Detection on streams with keyed state: each partition keeps its points and its strategy's evidence from slide to slide.

A partition has one timer, for its next slide. When the watermark has passed it, all slides up to the watermark are played on
the partition's detector (streaming.evidence): its state is read and written once for each micro-batch, however many slides
that holds. Points are written once, by pane. The partitions' counts of a window meet in a second stateful aggregation, so
that a window leaves the query as one row for each of its queries.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panewise.config import Algorithm, QuerySet
from panewise.job import OBSERVED
from panewise.operators.partitioning import Stripes
from panewise.plans.counting import reported
from panewise.streaming.evidence import Arrays, Detector, detector, pack, unpack

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory, and timers, need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def columns_of(table: pd.DataFrame) -> Arrays:
    return {
        "ids": table["id"].to_numpy(dtype=np.int64), "arrival": table["arrival"].to_numpy(dtype=np.int64), "flag": table["flag"].to_numpy(dtype=np.int8),
        "value": np.array(table["value"].tolist(), dtype=float),
    }


def together(parts: list[Arrays]) -> Arrays:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


class SlideProcessor(StatefulProcessor):
    """Plays a partition's slides on a detector of `make`."""

    #: Names and pandas types of the rows that slides give.
    types: dict[str, str] = {}

    def __init__(self, q: QuerySet, make: Callable[[], Detector]):
        self.q, self.make = q, make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "points binary")
        self.panes = handle.getMapState("panes", "pane long", "points binary")
        self.kept = handle.getValueState("kept", "evidence binary")
        #: The last slide that was played, and the slide of the timer (-1: none).
        self.clock = handle.getValueState("clock", "done long, timer long")

    def _clock(self) -> tuple[int, int]:
        found = self.clock.get() if self.clock.exists() else None
        return (int(found[0]), int(found[1])) if found else (-1, -1)

    def _next(self, arrival: int) -> int:
        return (arrival // self.q.slide + 1) * self.q.slide

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = together([columns_of(t) for t in rows])
        self.waiting.appendValue((pack(points),))
        first, (done, timer) = self._next(int(points["arrival"].min())), self._clock()
        if timer < 0 or first < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.clock.update((done, first))
        yield pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in self.types.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, _ = self._clock()
        limit = timerValues.getCurrentWatermarkInMs() // self.q.slide * self.q.slide
        chunks = [unpack(x[0]) for x in self.waiting.get()]
        found, stored = self.make(), dict(sorted((int(k[0]), v[0]) for k, v in self.panes.iterator()))
        found.load([unpack(x) for x in stored.values()], unpack(self.kept.get()[0]) if self.kept.exists() else {})
        points = together(chunks) if chunks else None
        if points is not None:
            order = np.argsort(points["arrival"], kind="stable")
            points = {name: x[order] for name, x in points.items()}
        at, total = 0, 0 if points is None else len(points["ids"])
        while len(found) or at < total:
            end = done + self.q.slide if len(found) else self._next(int(points["arrival"][at]))
            if end > limit:
                break
            upto = at if points is None else int(np.searchsorted(points["arrival"], end, "left"))
            new = {name: x[at:upto] for name, x in points.items()} if upto > at else None
            yield from self.play(found, end, new)
            done, at = end, upto
        live = set(np.unique(found.pane).tolist())
        for pane in stored.keys() - live:
            self.panes.removeKey((pane,))
        for pane in live - stored.keys():
            self.panes.updateValue((pane,), (pack(found.points(pane)),))
        self.kept.update((pack(found.evidence()),))
        rest = {name: x[at:] for name, x in points.items()} if at < total else None
        if chunks:
            self.waiting.put([(pack(rest),)]) if rest else self.waiting.clear()
        timer = done + self.q.slide if len(found) else self._next(int(rest["arrival"][0])) if rest else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        self.clock.update((done, timer))

    def play(self, found: Detector, end: int, new: Arrays | None) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class CountProcessor(SlideProcessor):
    """Counts of outliers of a partition at the end of every due slide, with the CPU time and the compared pairs since the last."""

    types = {"window_end": "int64", "at": "datetime64[ns, UTC]", "c": "object", "cpu_us": "int64", "compared": "int64"}

    def __init__(self, q: QuerySet, make: Callable[[], Detector]):
        super().__init__(q, make)
        self.spent = self.compared = 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent = self.compared = 0
        rows = [r for part in super().handleExpiredTimer(key, timerValues, expiredTimerInfo) for r in part]
        if rows:
            table = pd.DataFrame(rows, columns=list(self.types))
            table["at"] = pd.to_datetime(table["at"], unit="ms", utc=True)
            yield table

    def play(self, found: Detector, end: int, new: Arrays | None) -> Iterator[list[tuple]]:
        began = time.thread_time_ns()
        counts = found.slide(end, new, any(end % s == 0 for s in self.q.slides))
        self.spent += time.thread_time_ns() - began
        if counts is not None and any(c is not None for c in counts):
            yield [(end, end, counts, self.spent // 1000, found.compared - self.compared)]
            self.spent, self.compared = 0, found.compared


def detect_incremental(points: DataFrame, q: QuerySet, algorithm: Algorithm = Algorithm.PMCOD) -> DataFrame:
    """(window_end, R, k, w, s, outliers) of a stream of points by a strategy: one row for each window and query.

    Partitions are those of the column partition; without one, stripes of the first component with copies at their edges. A
    point may come up to the slide later than the newest; Spark drops later ones, so that times should start above 0. All
    partitions report a window in the micro-batch in which the watermark passes its end; there their counts are added up.
    """
    use_rocksdb(points.sparkSession)
    rows = points if "partition" in points.columns else Stripes().partition(points, q.max_range)
    rows = rows.select("partition", "id", "value", "arrival", "flag", F.timestamp_millis("arrival").alias("ts")).withWatermark("ts", f"{q.lateness} milliseconds")
    processor = CountProcessor(q, lambda: detector(algorithm, q))
    found = rows.groupBy("partition").transformWithStateInPandas(processor, "window_end long, at timestamp, c array<bigint>, cpu_us long, compared long", "append", "EventTime", eventTimeColumnName="at")
    n = len(q.ranges) * len(q.ks)
    sums = [F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(n * len(q.windows))]
    sums = found.groupBy("at").agg(F.max("window_end").alias("window_end"), *sums, F.sum("cpu_us").alias("cpu_us"), F.sum("compared").alias("compared"))
    sums = sums.observe(OBSERVED, F.count(F.lit(1)).alias("slides"), F.sum("cpu_us").alias("cpu_us"), F.sum("compared").alias("compared"), F.max("window_end").alias("last"))
    by_window = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), *[F.col(f"c{i * n + j}").alias(f"c{j}") for j in range(n)]) for i, w in enumerate(q.windows)])
    return reported(sums.select("window_end", F.explode(by_window).alias("r")).select("window_end", "r.*").where("c0 is not null"), q)


def detect_stateful(points: DataFrame, q: QuerySet) -> DataFrame:
    """detect_incremental() by the strategy that suits any query set."""
    return detect_incremental(points, q, Algorithm.PMCSKY)


class Window(Detector):
    """Live points and a dictionary of JSON values, for a user's function."""

    def __init__(self, q: QuerySet):
        super().__init__(q)
        self.state: dict = {}

    def evidence(self) -> Arrays:
        return {"state": np.frombuffer(json.dumps(self.state).encode(), dtype=np.uint8)}

    def load(self, points, evidence):
        super().load(points, evidence)
        if evidence:
            self.state = json.loads(evidence["state"].tobytes())

    def slide(self, end, points, due):
        self.expire(self.first_pane(end, self.q.max_window))
        if points is not None:
            self.append(points)

    def table(self) -> pd.DataFrame:
        order = np.lexsort((self.ids, self.arrival))
        return pd.DataFrame({"id": self.ids[order], "value": list(self.value[order]), "arrival": self.arrival[order], "flag": self.flag[order]})


class WindowProcessor(SlideProcessor):
    """Calls a user's function at the end of every due window, with a dictionary that lasts from window to window."""

    def __init__(self, q: QuerySet, function: Callable, columns: list[str]):
        super().__init__(q, lambda: Window(q))
        self.function, self.types = function, dict.fromkeys([*columns, "w", "window_end"], "object")

    def play(self, found: Window, end: int, new: Arrays | None) -> Iterator[pd.DataFrame]:
        found.slide(end, new, True)
        if len(found) and any(end % s == 0 for s in self.q.slides):
            yield from windows_of(found.table(), end, self.q, self.function, found.state)


def windows_of(table: pd.DataFrame, end: int, q: QuerySet, function: Callable, state: dict) -> Iterator[pd.DataFrame]:
    """What the function returns for each window length before `end` that holds points of the table."""
    for w in q.windows:
        live = table[(table["arrival"] >= end - w) & (table["arrival"] < end)].reset_index(drop=True)
        if len(live):
            yield function(int(end), int(w), live, state).assign(w=int(w), window_end=int(end))


def by_window_with_state(points: DataFrame, q: QuerySet, function: Callable, schema: str) -> DataFrame:
    """(window_end, R, k, w, s, outliers) by a function of (window_end, w, pandas table of points, dict); see strategies.by_window.

    Each partition (column partition; one, if there is none) has a dictionary of JSON values of its own, and its windows come
    in order. In a table a partition's points are one group in one task, so that they should be dealt by a partitioner; a
    function whose results can be merged should be a plans.combined.Combinable, which needs no such group.
    """
    rows = points if "partition" in points.columns else points.withColumn("partition", F.lit(0))
    rows, out = rows.select("partition", "id", "value", "arrival", "flag"), f"{schema}, w long, window_end long"
    if points.isStreaming:
        use_rocksdb(points.sparkSession)
        rows = rows.withColumn("ts", F.timestamp_millis("arrival")).withWatermark("ts", f"{q.lateness} milliseconds")
        columns = [x.name for x in points.sparkSession.createDataFrame([], schema).schema]
        found = rows.groupBy("partition").transformWithStateInPandas(WindowProcessor(q, function, columns), out, "append", "EventTime")
    else:

        def run(table: pd.DataFrame) -> pd.DataFrame:
            table, state, done = table.sort_values(["arrival", "id"], ignore_index=True), {}, []
            times = table["arrival"].to_numpy()
            ends = sorted({int(e) for e in ((times // q.slide + 1) * q.slide).tolist()})
            ends = sorted({e + k for e in ends for k in range(0, q.max_window, q.slide)})
            for end in (e for e in ends if any(e % s == 0 for s in q.slides)):
                low, high = np.searchsorted(times, [end - q.max_window, end])
                done += windows_of(table.iloc[low:high].drop(columns="partition"), end, q, function, state)
            return pd.concat(done) if done else pd.DataFrame({c: [] for c in ("w", "window_end")})

        found = rows.groupBy("partition").applyInPandas(run, out)
    slides = F.filter(F.array(*[F.lit(s).cast("long") for s in q.slides]), lambda s: F.col("window_end") % s == 0)
    return found.withColumn("s", F.explode(slides)).select("window_end", "R", "k", "w", "s", F.col("outliers").cast("long").alias("outliers"))
