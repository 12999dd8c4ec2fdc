"""The four steps as one chain: read points, partition them, detect outliers, write the counts."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewise import sinks
from panewise.config import Algorithm, Input, OutlierConfig
from panewise.errors import ConfigError
from panewise.job import OBSERVED, Job, Statistics, StreamJob
from panewise.operators import partitioning
from panewise.plans import strategies
from panewise.sources import points as sources


@dataclass(frozen=True)
class Pipeline:
    """A chain of lazy steps on DataFrames. Any step's table is a DataFrame that Spark's own operators work on."""

    spark: SparkSession
    config: OutlierConfig
    points: DataFrame | None = None
    parted: DataFrame | None = None
    results: DataFrame | None = None

    @classmethod
    def create(cls, spark: SparkSession, config: OutlierConfig) -> Pipeline:
        return cls(spark, config.validate())

    def read_data(self) -> Pipeline:
        """Points of the configured input; if it is not set, a file in debug mode and Kafka otherwise."""
        c, kind = self.config, self.config.input
        if kind is Input.UNKNOWN:
            kind = Input.FILE if c.debug else Input.KAFKA
        if kind is Input.KAFKA:
            if not (c.topic and c.brokers):
                raise ConfigError("Kafka needs a topic and brokers")
            return self.read_from(sources.read_kafka(self.spark, c.topic, c.brokers))
        home = c.home or os.environ.get("JOB_INPUT")
        if not home:
            raise ConfigError("the dataset's folder is not set")
        return self.read_from(sources.read_text(self.spark, f"{home.rstrip('/')}/{c.dataset}" if c.dataset else f"{home.rstrip('/')}/input_20k.txt"))

    def read_from(self, source: DataFrame | Callable[[SparkSession], DataFrame]) -> Pipeline:
        """Points of a table or stream of points, or of a user's source that makes one."""
        return replace(self, points=source if isinstance(source, DataFrame) else source(self.spark))

    def from_table(self, df: DataFrame, identity: str, coordinates: str | list[str], arrival: str) -> Pipeline:
        """Points of any table or stream, by its columns."""
        return self.read_from(sources.to_points(df, identity, coordinates, arrival))

    def transform(self, function: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """Applies a function to the newest table of the chain."""
        name = "results" if self.results is not None else "parted" if self.parted is not None else "points"
        return replace(self, **{name: function(getattr(self, name))})

    def partition(self, partitioner: partitioning.Partitioner | Callable | None = None) -> Pipeline:
        """Points dealt out with copies, by the configured partitioner or a given one."""
        c = self.config
        if partitioner is None:
            sample = lambda: sources.sample_values(self.spark, c.tree_file, c.tree_sample)
            partitioner = partitioning.of_config(c, sample)
        elif not isinstance(partitioner, partitioning.Partitioner):
            partitioner = partitioning.ByFunction(partitioner)
        if self.points is None:
            raise ConfigError("read points first")
        return replace(self, parted=self.points if partitioner is None else partitioner.partition(self.points, c.queries.max_range))

    def detect_outliers(self, detector: Callable | None = None) -> Pipeline:
        """Counts of outliers by the configured strategy, or by a user's (points, queries) -> results.

        A user's detector gets streams too and answers with a stream; `strategies.by_window` makes one that takes both.
        On tables, copies (flag 1) only serve strategies that count inside partitions: the others find neighbours by joins that
        need none. On streams every strategy keeps its evidence by partition.
        """
        c = self.config
        rows = self.parted if self.parted is not None else self.points
        if rows is None:
            raise ConfigError("read points first")
        detector = detector or c.detector
        if detector is not None:
            return replace(self, results=detector(rows, c.queries))
        if c.algorithm is Algorithm.USER_DEFINED:
            raise ConfigError("a user-defined algorithm needs a detector")
        if rows.isStreaming:
            from panewise.streaming.stateful import detect_incremental

            return replace(self, results=detect_incremental(rows, c.queries, c.algorithm))
        own = rows.where("flag = 0").drop("partition")
        if c.algorithm is Algorithm.ADVANCED_EXTENDED and "partition" in rows.columns:
            found = strategies.advanced_extended(own, c.queries, lambda points, r: rows)
        else:
            found = strategies.STRATEGIES[c.algorithm](own, c.queries)
        return replace(self, results=found)

    def aggregate(self) -> DataFrame:
        """The results, one row for each window and query."""
        if self.results is None:
            raise ConfigError("detect outliers first")
        return self.results if self.results.isStreaming else sinks.aggregated(self.results)

    def aggregate_and_write_to(self, sink: sinks.Sink, **options: str) -> Any:
        return sink.write(self.aggregate(), **options)

    def aggregate_and_write_data(self, **options: str) -> Any:
        return self.aggregate_and_write_to(sinks.auto(self.config), **options)

    def run(self, sink: sinks.Sink | None = None) -> Statistics:
        """Reads, partitions, detects and writes a bounded input; how long it took."""
        chain = self if self.points is not None else self.read_data()
        began = time.perf_counter()
        found = chain.partition().detect_outliers().aggregate().cache()
        (sink or sinks.auto(self.config)).write(found)
        out = Statistics(time.perf_counter() - began, found.select("window_end").distinct().count())
        found.unpersist()
        return out

    def start(self, sink: sinks.Sink | None = None, **options: str) -> Job | StreamJob:
        """run() in the background, or a stream's query; the handle tells how it goes and cancels it."""
        chain = self if self.points is not None else self.read_data()
        if not chain.points.isStreaming:
            return Job(self.spark, lambda: chain.run(sink))
        return StreamJob(self.spark, chain._begin(sink, options), options.get("checkpointLocation"))

    def resume_from(self, snapshot: str, sink: sinks.Sink | None = None, **options: str) -> StreamJob:
        """start() of a stream from a StreamJob's snapshot."""
        chain = self if self.points is not None else self.read_data()
        return StreamJob.from_snapshot(self.spark, chain._begin(sink, options), snapshot)

    def _begin(self, sink: sinks.Sink | None, options: dict[str, str]) -> Callable[[str], Any]:
        sink = sink or sinks.auto(self.config)
        return lambda log: self.partition().detect_outliers().observed().aggregate_and_write_to(sink, **{**options, "checkpointLocation": log})

    def observed(self) -> Pipeline:
        """A stream's results with their ends counted for the job's statistics, where the detection does not count its slides itself."""
        if self.config.detector is None:
            return self
        ends = F.approx_count_distinct("window_end", 0.01)
        return self.transform(lambda r: r.observe(OBSERVED, ends.alias("slides"), F.sum(F.lit(0)).alias("cpu_us"), F.sum(F.lit(0)).alias("compared")))
