"""A user's own stream of points, and lists that are replayed at the pace of their arrivals, as Spark data sources."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from panewise.sources.points import SCHEMA
from panewise.storage import new_path

Point = tuple[int, Sequence[float], int]


class StreamSource(ABC):
    """A source that is asked for what has come since the last time. It runs beside the driver, and so suits small streams."""

    @abstractmethod
    def available_items(self) -> Iterable[Point]:
        """The points (id, value, arrival) that have come; none if there are none now."""

    def is_complete(self) -> bool:
        """No more points will come."""
        return False

    def close(self) -> None:
        """Called once, after the last points."""


class Paced(StreamSource):
    """Points in the order of their arrivals, each when as much time has passed since the first as between the arrivals.

    speed: how many milliseconds of arrivals pass in one of the clock. None: simulated time, `step` ms of arrivals for each call.
    """

    def __init__(self, points: Iterable[Point], speed: float | None = 1.0, step: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.points = sorted(((int(p[0]), [float(v) for v in p[1]], int(p[2])) for p in points), key=lambda p: p[2])
        self.speed, self.step, self.clock, self.at, self.began, self.calls = speed, step, clock, 0, None, 0

    def available_items(self) -> list[Point]:
        if self.is_complete():
            return []
        self.calls += 1
        if self.speed is None:
            passed = self.step * self.calls
        else:
            self.began = self.clock() if self.began is None else self.began
            passed = (self.clock() - self.began) * 1000 * self.speed
        first, start = self.points[0][2], self.at
        while self.at < len(self.points) and self.points[self.at][2] - first <= passed:
            self.at += 1
        return self.points[start : self.at]

    def is_complete(self) -> bool:
        return self.at >= len(self.points)


class _Reader(SimpleDataSourceStreamReader):
    """Numbers the points of a source. What has been read stays until Spark commits it, so that a batch can be read again."""

    def __init__(self, source: StreamSource):
        self.source, self.first, self.kept, self.closed = source, 0, [], False

    def initialOffset(self) -> dict:
        return {"points": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["points"] > self.first + len(self.kept):  # a restarted query goes on from its checkpoint
            self.first, self.kept = start["points"], []
        if not self.source.is_complete():
            self.kept += [(int(i), [float(x) for x in v], int(t), 0) for i, v, t in self.source.available_items()]
        if self.source.is_complete() and not self.closed:
            self.closed = True
            self.source.close()
        end = {"points": self.first + len(self.kept)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.kept[start["points"] - self.first : end["points"] - self.first])

    def commit(self, end: dict) -> None:
        self.kept = self.kept[end["points"] - self.first :]
        self.first = end["points"]


def read_custom(spark: SparkSession, make: Callable[[], StreamSource], name: str = "panewise_points") -> DataFrame:
    """A stream of the points of the source that `make` makes.

    A restarted query goes on counting from its checkpoint, but the source starts anew: what it gave before and Spark had not
    committed is lost unless it gives it again. A PartitionedSource has no such gap.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Reader(make())

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


class PartitionedSource(ABC):
    """A stream whose points executors read, in parts. Offsets are the source's own JSON values; equal offsets give equal points.

    Spark logs a batch's offsets before the batch is read, and gives them back after a restart: what was not finished is read
    again, and the source goes on from the last offset.
    """

    @abstractmethod
    def start(self) -> dict:
        """The offset before the first point."""

    @abstractmethod
    def advance(self, offset: dict) -> dict:
        """How far points have come, at or after an offset; called beside the driver, and cheap."""

    @abstractmethod
    def parts(self, start: dict, end: dict) -> Sequence[Any]:
        """What tasks read for the points from one offset to another, a value for each task."""

    @abstractmethod
    def read(self, part: Any) -> Iterator[tuple[int, Sequence[float], int, int]]:
        """The points (id, value, arrival, flag) of a part, in a task."""


class _Part(InputPartition):
    def __init__(self, value: Any):
        self.value = value


class _PartReader(DataSourceStreamReader):
    def __init__(self, source: PartitionedSource):
        self.source, self.at = source, None

    def initialOffset(self) -> dict:
        return self.source.start()

    def latestOffset(self) -> dict:
        self.at = self.source.advance(self.source.start() if self.at is None else self.at)
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end if self.at is None else self.at  # after a restart Spark plans the last batch again
        return [_Part(p) for p in self.source.parts(start, end)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, v, t, flag in self.source.read(partition.value):
            yield int(i), [float(x) for x in v], int(t), int(flag)


def read_partitioned(spark: SparkSession, source: PartitionedSource, name: str = "panewise_parts") -> DataFrame:
    """A stream of the points of a partitioned source."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _PartReader(source)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


class TableReplay(PartitionedSource):
    """A table of points as a stream in the order of their arrivals: each offset is a time, up to which points have arrived.

    path: a folder of Parquet files of points that pyarrow can reach from every executor. speed: ms of arrivals that pass in one
    of the clock; None: `step` ms for each micro-batch. Only files whose arrivals (by their statistics) lie in a batch are read.
    """

    def __init__(self, path: str, speed: float | None = 1.0, step: int = 1000):
        self.speed, self.step, self.began = speed, step, None
        files, self.path = pads.dataset(path), path
        self.files = []
        for part in files.get_fragments():
            groups = [g.statistics["arrival"] for g in part.row_groups if "arrival" in (g.statistics or {})]
            if groups:
                self.files.append((part.path, min(g["min"] for g in groups), max(g["max"] for g in groups)))
        self.first = min((f[1] for f in self.files), default=0)
        self.last = max((f[2] for f in self.files), default=-1)

    def start(self) -> dict:
        return {"until": self.first}

    def advance(self, offset: dict) -> dict:
        if self.speed is None:
            passed = self.step
        else:  # the clock starts anew with a restarted query
            now = time.monotonic()
            self.began = now if self.began is None else self.began
            passed, self.began = (now - self.began) * 1000 * self.speed, now
        return {"until": min(int(offset["until"] + passed), self.last + 1)}

    def parts(self, start: dict, end: dict) -> list[tuple[str, int, int]]:
        return [(name, start["until"], end["until"]) for name, low, high in self.files if low < end["until"] and high >= start["until"]]

    def read(self, part: tuple[str, int, int]) -> Iterator[tuple[int, Sequence[float], int, int]]:
        name, low, high = part
        source = pads.dataset(name, filesystem=pads.dataset(self.path).filesystem)
        inside = (pads.field("arrival") >= low) & (pads.field("arrival") < high)
        for batch in source.to_batches(columns=["id", "value", "arrival", "flag"], filter=inside):
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))


def replay_table(spark: SparkSession, points: DataFrame, speed: float | None = 1.0, step: int = 1000, name: str = "panewise_table_replay") -> DataFrame:
    """Any table of points as a stream at the pace of their arrivals, times `speed`; None: `step` ms of arrivals for each micro-batch.

    Spark writes the points to the shared folder in ranges of arrival, each read by its own tasks when its time has come.
    """
    path = new_path(spark, "replayed-points")
    points.select("id", "value", "arrival", "flag").repartitionByRange("arrival", "id").sortWithinPartitions("arrival", "id").write.parquet(path)
    return read_partitioned(spark, TableReplay(path.removeprefix("file://") if path.startswith("file:///") else path, speed, step), name)


def replay(spark: SparkSession, points: Iterable[Point], speed: float | None = 1.0, step: int = 1000, name: str = "panewise_replay") -> DataFrame:
    """A list of points as a stream at the pace of their arrivals, times `speed`; None: `step` ms of arrivals for each micro-batch."""
    rows = list(points)
    return read_custom(spark, lambda: Paced(rows, speed, step), name)
