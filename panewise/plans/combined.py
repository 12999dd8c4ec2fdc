"""Users' functions of windows whose results can be merged, on tables and streams.

A function turns any points of a pane into a partial result, merges two of them, and finishes a window from the merged result
of its panes. Points are never brought together: each task merges the partial results of the panes that it sees, and only
these are shuffled, first by pane, then by window. A function with state gets the windows of a length in order; what one task
then goes through are the windows' merged results.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panewise.config import QuerySet

#: Panes that a task holds at once while it merges.
PANES = 10_000
RESULT = "w long, window_end long, R double, k int, outliers long"
Rows = Iterable[tuple[float, int, int]]


class Combinable(ABC):
    """A function of windows in three steps. Partial results and the state are JSON values."""

    #: finish() needs the state of the window before; windows of a length then come in order.
    stateful = False

    @abstractmethod
    def update(self, points: pd.DataFrame) -> Any:
        """The partial result of some points (id, value, arrival) of a pane."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any:
        """Of two partial results one; in whichever order they come, the result is the same."""

    @abstractmethod
    def finish(self, end: int, w: int, partial: Any, state: dict) -> Rows:
        """(R, k, outliers) of the window of length w before `end`; state lasts from window to window of a length."""

    def __call__(self, points: DataFrame, q: QuerySet) -> DataFrame:
        return detect_combined(points, q, self)


def _partials(rows: DataFrame, q: QuerySet, function: Combinable) -> DataFrame:
    """(pane, part): partial results of the points that a task sees, merged by pane."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Any] = {}
        flush = lambda: pd.DataFrame({"pane": list(held), "part": [json.dumps(v) for v in held.values()]})
        for table in tables:
            for pane, points in table.groupby("pane"):
                part = function.update(points.drop(columns="pane").reset_index(drop=True))
                held[int(pane)] = function.merge(held[int(pane)], part) if int(pane) in held else part
            if len(held) > PANES:
                yield flush()
                held.clear()
        if held:
            yield flush()

    pane = F.floor(F.col("arrival") / q.pane).cast("long").alias("pane")
    return rows.where("flag = 0").select("id", "value", "arrival", pane).mapInPandas(run, "pane long, part string")


def _merged(rows: DataFrame, keys: list[str], function: Combinable) -> DataFrame:
    """(keys, part): one partial result for each key; a task goes through its rows in order and holds one result."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part = None, None
        for table in tables:
            out = []
            for *now, text in table[[*keys, "part"]].itertuples(index=False):
                if now == key:
                    part = function.merge(part, json.loads(text))
                else:
                    if key is not None:
                        out.append((*key, json.dumps(part)))
                    key, part = now, json.loads(text)
            if out:
                yield pd.DataFrame(out, columns=[*keys, "part"])
        if key is not None:
            yield pd.DataFrame([(*key, json.dumps(part))], columns=[*keys, "part"])

    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, ", ".join(f"{k} long" for k in keys) + ", part string")


def _finished(windows: DataFrame, function: Combinable) -> DataFrame:
    """Rows of finish() for each window (w, window_end, part)."""

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, dict] = {}
        for table in tables:
            out = []
            for w, end, text in table[["w", "window_end", "part"]].itertuples(index=False):
                state = states.setdefault(int(w), {}) if function.stateful else {}
                out += [(w, end, *row) for row in function.finish(int(end), int(w), json.loads(text), state)]
            yield pd.DataFrame(out, columns=["w", "window_end", "R", "k", "outliers"])

    if function.stateful:
        windows = windows.repartition(F.col("w")).sortWithinPartitions("w", "window_end")
    return windows.mapInPandas(run, RESULT)


def _by_slide(found: DataFrame, q: QuerySet) -> DataFrame:
    slides: Column = F.filter(F.array(*[F.lit(s).cast("long") for s in q.slides]), lambda s: F.col("window_end") % s == 0)
    return found.withColumn("s", F.explode(slides)).select("window_end", "R", "k", "w", "s", F.col("outliers").cast("long").alias("outliers"))


def detect_combined(points: DataFrame, q: QuerySet, function: Combinable) -> DataFrame:
    """(window_end, R, k, w, s, outliers) by a Combinable, of a table or a stream of points; copies (flag 1) do not count."""
    from panewise.plans.counting import in_windows

    if points.isStreaming:
        return _detect_stream(points, q, function)
    panes = _merged(_partials(points, q, function), ["pane"], function)
    windows = _merged(in_windows(panes, q, "pane", "pane").select("w", "window_end", "part"), ["w", "window_end"], function)
    return _by_slide(_finished(windows, function), q)


class CombinedProcessor(StatefulProcessor):
    """Partial results by pane, merged as they come; windows are finished when the watermark has passed their ends."""

    def __init__(self, q: QuerySet, function: Combinable):
        self.q, self.function = q, function

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "part string")
        self.clock = handle.getValueState("clock", "done long, timer long, state string")

    def _clock(self) -> tuple[int, int, dict]:
        found = self.clock.get() if self.clock.exists() else None
        return (int(found[0]), int(found[1]), json.loads(found[2])) if found else (-1, -1, {})

    def _first_end(self, pane: int) -> int:
        return pane * self.q.pane // self.q.slide * self.q.slide + self.q.slide

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, Any] = {}
        for table in rows:
            for pane, text in table[["pane", "part"]].itertuples(index=False):
                part = json.loads(text)
                new[int(pane)] = self.function.merge(new[int(pane)], part) if int(pane) in new else part
        for pane, part in new.items():
            if self.panes.containsKey((pane,)):
                part = self.function.merge(json.loads(self.panes.getValue((pane,))[0]), part)
            self.panes.updateValue((pane,), (json.dumps(part),))
        done, timer, state = self._clock()
        first = max(self._first_end(min(new)), done + self.q.slide if done >= 0 else 0)
        if timer < 0 or first < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.clock.update((done, first, json.dumps(state)))
        yield pd.DataFrame({c: pd.Series(dtype="object") for c in ("w", "window_end", "R", "k", "outliers")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        q, (_, _, states) = self.q, self._clock()
        limit = timerValues.getCurrentWatermarkInMs() // q.slide * q.slide
        panes = {int(k[0]): json.loads(v[0]) for k, v in self.panes.iterator()}
        end, out, gone = expiredTimerInfo.getExpiryTimeInMs(), [], []
        while panes and end <= limit:
            if any(end % s == 0 for s in q.slides):
                for w in q.windows:
                    part, any_pane = None, False
                    for pane in sorted(p for p in panes if (end - w) // q.pane <= p < end // q.pane):
                        part, any_pane = self.function.merge(part, panes[pane]) if any_pane else panes[pane], True
                    if any_pane:
                        state = states.setdefault(str(w), {}) if self.function.stateful else {}
                        out += [(w, end, *row) for row in self.function.finish(end, w, part, state)]
            old = [p for p in panes if p < (end + q.slide - q.max_window) // q.pane]
            gone += old
            for pane in old:
                del panes[pane]
            end = max(end + q.slide, self._first_end(min(panes))) if panes else end
        for pane in gone:
            self.panes.removeKey((pane,))
        if panes:
            self.handle.registerTimer(end)
        self.clock.update((end - q.slide if panes else end, end if panes else -1, json.dumps(states)))
        if out:
            yield pd.DataFrame(out, columns=["w", "window_end", "R", "k", "outliers"])

    def close(self) -> None:
        pass


def _detect_stream(points: DataFrame, q: QuerySet, function: Combinable) -> DataFrame:
    """Each micro-batch's partial results, at most one for a pane and task, go to the state of one key."""
    from panewise.streaming.stateful import use_rocksdb

    use_rocksdb(points.sparkSession)
    parts = _partials(points, q, function).withColumn("ts", F.timestamp_millis(F.col("pane") * q.pane)).withWatermark("ts", f"{q.lateness} milliseconds")
    found = parts.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(CombinedProcessor(q, function), RESULT, "append", "EventTime")
    return _by_slide(found, q)
