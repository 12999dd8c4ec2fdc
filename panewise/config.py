"""What to detect and how: query sets, option names, validation, a fluent builder and command-line arguments."""

from __future__ import annotations

import argparse
import math
import os
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from panewise.errors import ConfigError, UnsupportedSpaceError


class _Named(str, Enum):
    @classmethod
    def of(cls, name: str | _Named):
        wanted = str(name.value if isinstance(name, Enum) else name).replace("_", "").replace("-", "").lower()
        for option in cls:
            if option.value.replace("_", "") == wanted:
                return option
        raise ConfigError(f"{name!r} is none of {', '.join(o.value for o in cls)}")


class Space(_Named):
    """Single query; sets of ranges and k; or sets of ranges, k, windows and slides."""

    SINGLE = "single"
    RK = "rk"
    RKWS = "rkws"


class Algorithm(_Named):
    NAIVE = "naive"
    ADVANCED = "advanced"
    ADVANCED_EXTENDED = "advanced_extended"
    SLICING = "slicing"
    PMCOD = "pmcod"
    PMCOD_NET = "pmcod_net"
    AMCOD = "amcod"
    SOP = "sop"
    PSOD = "psod"
    PMCSKY = "pmcsky"
    #: Not by points but by their values; for tables of which many points share a value.
    BY_VALUE = "by_value"
    USER_DEFINED = "user_defined"

    @property
    def spaces(self) -> frozenset[Space]:
        if self in (Algorithm.USER_DEFINED, Algorithm.BY_VALUE):
            return frozenset(Space)
        if self is Algorithm.AMCOD:
            return frozenset({Space.RK})
        return frozenset({Space.RK, Space.RKWS} if self in (Algorithm.SOP, Algorithm.PSOD, Algorithm.PMCSKY) else {Space.SINGLE})


class Partitioning(_Named):
    REPLICATION = "replication"
    GRID = "grid"
    TREE = "tree"
    USER_DEFINED = "user_defined"


class Input(_Named):
    FILE = "file"
    KAFKA = "kafka"
    UNKNOWN = "unknown"


class Output(_Named):
    PRINT = "print"
    INFLUXDB = "influxdb"
    UNKNOWN = "unknown"


@dataclass(frozen=True)
class QuerySet:
    """All combinations of ranges, neighbour counts, windows and slides (both in milliseconds)."""

    ranges: tuple[float, ...]
    ks: tuple[int, ...]
    windows: tuple[int, ...]
    slides: tuple[int, ...]

    @classmethod
    def of(cls, k: int | Iterable[int], r: float | Iterable[float], w: int | Iterable[int], s: int | Iterable[int]) -> QuerySet:
        def listed(x: Any, kind: type) -> tuple:
            return tuple(sorted({kind(v) for v in (x if isinstance(x, Iterable) else [x])}))

        found = cls(listed(r, float), listed(k, int), listed(w, int), listed(s, int))
        if not all((found.ranges, found.ks, found.windows, found.slides)):
            raise ConfigError("every parameter needs a value")
        if min(found.ranges) <= 0 or min(found.ks) < 1 or min(found.windows) < 1 or min(found.slides) < 1:
            raise ConfigError("ranges, k, windows and slides must be positive")
        return found

    @property
    def pane(self) -> int:
        """The largest step that all windows and slides are multiples of."""
        return math.gcd(*self.windows, *self.slides)

    @property
    def slide(self) -> int:
        return math.gcd(*self.slides)

    @property
    def max_window(self) -> int:
        return self.windows[-1]

    @property
    def max_range(self) -> float:
        return self.ranges[-1]

    @property
    def lateness(self) -> int:
        """How much later than the newest a point may come in a stream."""
        return self.slide

    @property
    def space(self) -> Space:
        if len(self.windows) > 1 or len(self.slides) > 1:
            return Space.RKWS
        return Space.RK if len(self.ranges) > 1 or len(self.ks) > 1 else Space.SINGLE


@dataclass(frozen=True)
class OutlierConfig:
    """A detection job. `partitioner` is a user's partitioning function or grid; `detector` a user's detection strategy."""

    algorithm: Algorithm
    space: Space
    queries: QuerySet
    dataset: str = ""
    input: Input = Input.UNKNOWN
    home: str | None = None
    topic: str | None = None
    brokers: str | None = None
    partitioning: Partitioning | None = None
    partitions: int = 16
    tree_sample: int = 10_000
    tree_file: str | None = None
    partitioner: Any = None
    detector: Any = None
    output: Output = Output.UNKNOWN
    sink_options: Mapping[str, str] = field(default_factory=dict)
    debug: bool = False

    def validate(self) -> OutlierConfig:
        """Itself, or ConfigError."""
        if self.algorithm is not Algorithm.USER_DEFINED and self.space not in self.algorithm.spaces:
            raise UnsupportedSpaceError(f"{self.algorithm.value} does not answer {self.space.value} query sets")
        q = self.queries
        if self.space is Space.SINGLE and q.space is not Space.SINGLE or self.space is Space.RK and q.space is Space.RKWS:
            raise UnsupportedSpaceError(f"the queries are no {self.space.value} set")
        if self.partitions < 1:
            raise ConfigError("partitions must be positive")
        if self.algorithm is Algorithm.USER_DEFINED or self.partitioning in (None, Partitioning.USER_DEFINED):
            if self.partitioning is Partitioning.USER_DEFINED and self.partitioner is None:
                raise ConfigError("user-defined partitioning needs a partitioner")
            return self
        replicated = self.algorithm in (Algorithm.NAIVE, Algorithm.ADVANCED)
        if replicated != (self.partitioning is Partitioning.REPLICATION):
            raise ConfigError("replication partitioning goes with naive and advanced, and they with it")
        if self.partitioning is Partitioning.GRID and self.partitioner is None and self.dataset.lower() not in ("stk", "tao"):
            raise ConfigError("grid partitioning needs a grid for this dataset")
        if self.partitioning is Partitioning.TREE and not (self.tree_file or self.partitioner):
            raise ConfigError("tree partitioning needs a file of sample points, or a fitted tree")
        return self

    @staticmethod
    def builder() -> Builder:
        return Builder()

    @staticmethod
    def from_args(args: Sequence[str]) -> OutlierConfig:
        """From command-line arguments and the environment's JOB_INPUT, KAFKA_BROKERS, KAFKA_TOPIC and INFLUXDB_* values."""
        listed = lambda kind: lambda text: [kind(x) for x in text.split(";") if x.strip()]
        known = argparse.ArgumentParser(prog="panewise", allow_abbrev=False)
        for name, kind in (("space", Space.of), ("algorithm", Algorithm.of), ("W", listed(int)), ("S", listed(int)), ("k", listed(int)), ("R", listed(float)), ("dataset", str), ("partitioning", Partitioning.of)):
            known.add_argument(f"--{name}", type=kind, required=True)
        known.add_argument("--tree_init", type=int)
        known.add_argument("--debug", type=truth, default=False)
        try:
            x = known.parse_args(list(args))
        except SystemExit as error:
            raise ConfigError(f"cannot read arguments {list(args)}") from error
        if x.tree_init is not None and x.partitioning is not Partitioning.TREE:
            raise ConfigError("tree_init goes with tree partitioning only")
        home = os.environ.get("JOB_INPUT")
        tree_file = f"{home or '.'}/{x.dataset}_tree_input.txt" if x.partitioning is Partitioning.TREE else None
        sink = {k: os.environ[f"INFLUXDB_{k.upper()}"] for k in ("host", "user", "password", "db") if f"INFLUXDB_{k.upper()}" in os.environ}
        found = OutlierConfig(x.algorithm, x.space, QuerySet.of(x.k, x.R, x.W, x.S), dataset=x.dataset, home=home, topic=os.environ.get("KAFKA_TOPIC"), brokers=os.environ.get("KAFKA_BROKERS"), partitioning=x.partitioning, tree_sample=x.tree_init or 10_000, tree_file=tree_file, sink_options=sink, debug=x.debug)
        return found.validate()


def truth(text: str) -> bool:
    """A truth value as people write it; ConfigError for anything else."""
    word = text.strip().lower()
    if word in ("1", "true", "t", "yes", "y", "on"):
        return True
    if word in ("0", "false", "f", "no", "n", "off", ""):
        return False
    raise ConfigError(f"{text!r} is no truth value")


class Builder:
    """Builds an OutlierConfig step by step: algorithm, space, queries, dataset and input, partitioning, output."""

    def __init__(self, **known: Any):
        self._known = known

    def _with(self, **more: Any) -> Builder:
        return Builder(**{**self._known, **more})

    def for_algorithm(self, algorithm: Algorithm | str) -> Builder:
        return self._with(algorithm=Algorithm.of(algorithm))

    def user_defined(self, detector: Any) -> Builder:
        return self._with(algorithm=Algorithm.USER_DEFINED, detector=detector)

    def in_single_space(self) -> Builder:
        return self._with(space=Space.SINGLE)

    def in_rk_space(self) -> Builder:
        return self._with(space=Space.RK)

    def in_rkws_space(self) -> Builder:
        return self._with(space=Space.RKWS)

    def querying(self, k: int | Iterable[int], r: float | Iterable[float], w: int | Iterable[int], s: int | Iterable[int]) -> Builder:
        return self._with(queries=QuerySet.of(k, r, w, s))

    def for_dataset_named(self, name: str) -> Builder:
        return self._with(dataset=name)

    def located_in(self, home: str) -> Builder:
        return self._with(input=Input.FILE, home=home)

    def from_kafka(self, topic: str, brokers: str) -> Builder:
        return self._with(input=Input.KAFKA, topic=topic, brokers=brokers)

    def replication_partitioned(self, partitions: int = 16) -> Builder:
        return self._with(partitioning=Partitioning.REPLICATION, partitions=partitions)

    def grid_partitioned(self, grid: Any = None) -> Builder:
        return self._with(partitioning=Partitioning.GRID, partitioner=grid)

    def tree_partitioned(self, file: str, sample: int = 10_000, partitions: int = 16) -> Builder:
        return self._with(partitioning=Partitioning.TREE, tree_file=file, tree_sample=sample, partitions=partitions)

    def user_partitioned(self, partitioner: Callable) -> Builder:
        return self._with(partitioning=Partitioning.USER_DEFINED, partitioner=partitioner)

    def printing_outliers(self) -> Builder:
        return self._with(output=Output.PRINT)

    def writing_outliers_to_influxdb(self, database: str, host: str, user: str = "", password: str = "") -> Builder:
        return self._with(output=Output.INFLUXDB, sink_options={"db": database, "host": host, "user": user, "password": password})

    def enabling_debug(self) -> Builder:
        return self._with(debug=True)

    def build(self) -> OutlierConfig:
        missing = [k for k in ("algorithm", "space", "queries") if k not in self._known]
        if missing:
            raise ConfigError(f"not set: {', '.join(missing)}")
        return replace(OutlierConfig(self._known["algorithm"], self._known["space"], self._known["queries"]), **self._known).validate()
