"""Registered queries that go through whole chains: configuration, source, partitioner, detection, sink; on tables and streams."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewise import sinks
from panewise.config import OutlierConfig, QuerySet, Space
from panewise.operators import partitioning
from panewise.pipeline import Pipeline
from panewise.plans import strategies
from panewise.plans.combined import Combinable
from panewise.queries import _EVENTS, HOUR, RK, RKWS, SINGLE, SQL as PLAIN_SQL, Query, _own_window, detect_sql, events
from panewise.sources import custom
from panewise.sources import points as sources
from panewise.storage import new_path
from panewise.streaming import stateful, windows

RESULTS = "window_end long, R double, k int, w long, s long, outliers long"
#: Time (ms) of the point that ends a stream, after all others: its windows are left out.
FAR = 1_893_456_000_000
#: Query set of points that arrive at their ids.
BY_ID = QuerySet.of(5, 0.5, 2000, 500)
NATIONS = QuerySet.of([1, 3], [0.5, 1.5], [10, 20], 5)
#: Grid for a stream's keys.
STREAM_GRID = partitioning.Grid(((5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 50.0, 60.0, 75.0, 90.0, 120.0, 160.0),))


class FolderSink(sinks.Sink):
    """Results as Parquet under a folder, a stream's batch in a folder of its own."""

    def __init__(self, path: str):
        self.path = path

    def write_batch(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch=-1")

    def write_stream_batch(self, rows: DataFrame, batch: int, query: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{RESULTS}, batch int").parquet(self.path).drop("batch")


class Cheap(strategies.Detector):
    """A user's detector: only points below 50 count."""

    spaces = frozenset(Space)

    def transform(self, points: DataFrame) -> DataFrame:
        return points.where(F.col("value")[0] < 50)

    def detect(self, points: DataFrame, queries: QuerySet) -> DataFrame:
        return strategies.slicing(points, queries)


class Newcomers(Combinable):
    """A user's function with state: points that arrived after all points of earlier windows."""

    stateful = True

    def update(self, points) -> dict:
        """Newest arrival and number of the points of each slide."""
        found = points.groupby(points["arrival"] // SINGLE.slide)["arrival"].agg(["max", "count"])
        return {str(i): [int(newest), int(n)] for i, newest, n in found.itertuples()}

    def merge(self, a: dict, b: dict) -> dict:
        return {i: [max(x[0] for x in parts), sum(x[1] for x in parts)] for i in {**a, **b} if (parts := [x[i] for x in (a, b) if i in x])}

    def finish(self, end: int, w: int, partial: dict, state: dict) -> list:
        last, state["last"] = state.get("last", -1), max(newest for newest, _ in partial.values())
        return [(0.0, 0, sum(n for newest, n in partial.values() if newest > last))]


class RareValues(Combinable):
    """A user's function: points that fewer than k of their window share the whole part of their value with, the point included."""

    def update(self, points) -> dict:
        return {str(int(v)): int(n) for v, n in points["value"].str[0].floordiv(1).value_counts().items()}

    def merge(self, a: dict, b: dict) -> dict:
        return {v: a.get(v, 0) + b.get(v, 0) for v in {**a, **b}}

    def finish(self, end: int, w: int, partial: dict, state: dict) -> list:
        return [(1.0, k, sum(n for n in partial.values() if n < k)) for k in RKWS.ks]


def _config(algorithm: str, q: QuerySet = SINGLE):
    b = OutlierConfig.builder().for_algorithm(algorithm)
    b = b.in_single_space() if q.space is Space.SINGLE else b.in_rk_space() if q.space is Space.RK else b.in_rkws_space()
    return b.querying(q.ks, q.ranges, q.windows, q.slides)


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments name everything; points are lines of a text file, and arrive at their ids."""
    home = new_path(spark, "lines")
    events(spark, sf_dir).select(F.concat_ws("&", "id", F.col("value")[0])).write.text(f"{home}/stk")
    args = "--space single --algorithm pmcod --k 5 --R 0.5 --W 2000 --S 500 --dataset stk --partitioning grid --debug true"
    config = replace(OutlierConfig.from_args(args.split()), home=home)
    return Pipeline.create(spark, config).read_data().partition().detect_outliers().aggregate()


def tree_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that is fitted on a file of sample points deals the points; outliers are counted inside partitions."""
    file, rows = new_path(spark, "sample"), events(spark, sf_dir)
    rows.select(F.col("value")[0].cast("string")).write.text(file)
    config = _config("advanced_extended").tree_partitioned(file, 2000, 8).build()
    return Pipeline.create(spark, config).read_from(rows).partition().detect_outliers().aggregate()


class Bands(partitioning.Partitioner):
    """A user's partitioner: bands of values, 20 wide, with copies for the bands that the range touches."""

    def memberships(self, r: float):
        band = lambda x: F.floor(x / 20).cast("int")
        x = F.col("value")[0]
        return F.transform(F.sequence(band(x - r), band(x + r)), lambda p: F.struct(p.alias("partition"), F.when(p == band(x), 0).otherwise(1).alias("flag")))


def users_partitioner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers are counted inside the partitions of a user's class."""
    chain = Pipeline.create(spark, _config("advanced_extended").build()).read_from(events(spark, sf_dir))
    return chain.partition(Bands()).detect_outliers().aggregate()


def stream_users_partitioner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream: evidence is kept by the user's partitions."""
    chain = Pipeline.create(spark, _config("advanced_extended").build())
    return streamed(spark, events(spark, sf_dir), lambda s, sink, log: chain.read_from(s).partition(Bands()).detect_outliers().aggregate_and_write_to(sink, checkpointLocation=log))


def tree_file_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, owners): every point has one partition of its own, whatever tree the sample gives."""
    file, rows = new_path(spark, "sample"), events(spark, sf_dir)
    rows.select(F.col("value")[0].cast("string")).write.text(file)
    config = _config("pmcod").tree_partitioned(file, 2000, 8).build()
    parted = Pipeline.create(spark, config).read_from(rows).partition().parted
    return parted.groupBy("id").agg(F.sum(1 - F.col("flag")).alias("owners"))


def users_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's source, Spark's own operators in the chain (every second point), and a query set by the builder."""
    chain = Pipeline.create(spark, _config("sop", RKWS).build()).read_from(lambda s: events(s, sf_dir))
    return chain.transform(lambda p: p.where("id % 2 = 0")).detect_outliers().transform(lambda r: r.where("k > 3")).aggregate()


def users_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = OutlierConfig.builder().user_defined(Cheap()).in_rkws_space().querying(RKWS.ks, RKWS.ranges, RKWS.windows, RKWS.slides)
    return Pipeline.create(spark, b.build()).from_table(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", ["value"], "ts").detect_outliers().aggregate()


def state_between_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Newcomers()(events(spark, sf_dir), SINGLE)


def _rare_values() -> OutlierConfig:
    return OutlierConfig.builder().user_defined(RareValues()).in_rkws_space().querying(RKWS.ks, RKWS.ranges, RKWS.windows, RKWS.slides).build()


def combined_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline.create(spark, _rare_values()).read_from(events(spark, sf_dir)).detect_outliers().aggregate()


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float], int]]:
    """The nations as a list of points; there are 25 at every scale."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    return [(r[0], [float(r[1])], r[0]) for r in rows]


def list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Pipeline.create(spark, _config("amcod", QuerySet.of(NATIONS.ks, NATIONS.ranges, 10, 5)).build())
    return chain.read_from(sources.from_list(spark, _nations(spark, sf_dir))).detect_outliers().aggregate()


def list_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, arrival, flag): a list as a stream of five milliseconds of arrivals at a time, written and read back."""
    path = new_path(spark, "replayed")
    stream = custom.replay(spark, _nations(spark, sf_dir), None, 5, "panewise_nations")
    query = stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "replay-log")).start(path)
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(path).select("id", F.col("value")[0].alias("v"), "arrival", "flag")


def streamed(spark: SparkSession, points: DataFrame, start: Callable[[DataFrame, sinks.Sink, str], object]) -> DataFrame:
    """Results of a stream of the points, then of a far one that ends its windows; the far windows are left out.

    start: from the stream, a sink and a checkpoint's path to the running query.
    """
    folder, sink = new_path(spark, "stream"), FolderSink(new_path(spark, "stream-out"))
    points.write.mode("append").parquet(folder)
    query = start(sources.replayed(spark, folder, 1_000_000), sink, new_path(spark, "stream-log"))
    query.processAllAvailable()
    sources.from_list(spark, [(-1, [1e9], FAR)]).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    return sinks.aggregated(sink.read(spark).where(F.col("window_end") < FAR))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Pipeline.create(spark, _config("sop", RKWS).build())
    return streamed(spark, events(spark, sf_dir), lambda s, sink, log: chain.read_from(s).partition(STREAM_GRID).detect_outliers(windows.detect_stream).aggregate_and_write_to(sink, checkpointLocation=log))


def stream_strategy(algorithm: str, q: QuerySet = SINGLE, grid: bool = True) -> Query:
    """A configured strategy on the stream of events, with the grid's partitions or the default ones."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        chain = Pipeline.create(spark, _config(algorithm, q).build())
        dealt = lambda s: chain.read_from(s).partition(STREAM_GRID) if grid else chain.read_from(s)
        return streamed(spark, events(spark, sf_dir), lambda s, sink, log: dealt(s).detect_outliers().aggregate_and_write_to(sink, checkpointLocation=log))

    return query


def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Pipeline.create(spark, _config("pmcod").build())
    return streamed(spark, events(spark, sf_dir), lambda s, sink, log: chain.read_from(s).partition(STREAM_GRID).detect_outliers(stateful.detect_stateful).aggregate_and_write_to(sink, checkpointLocation=log))


def stream_users_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = OutlierConfig.builder().user_defined(strategies.by_window(_own_window)).in_single_space().querying(SINGLE.ks, SINGLE.ranges, SINGLE.max_window, SINGLE.slide)
    chain = Pipeline.create(spark, b.build())
    return streamed(spark, events(spark, sf_dir), lambda s, sink, log: chain.read_from(s).detect_outliers().aggregate_and_write_to(sink, checkpointLocation=log))


def stream_combined_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Pipeline.create(spark, _rare_values())
    return streamed(spark, events(spark, sf_dir), lambda s, sink, log: chain.read_from(s).detect_outliers().aggregate_and_write_to(sink, checkpointLocation=log))


def stream_state_between_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, events(spark, sf_dir), lambda s, sink, log: sink.write(Newcomers()(s, SINGLE), checkpointLocation=log))


def stream_table_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is replayed, five days at a time, by a source that executors read; the job is suspended on the way and goes on.

    Windows that the last points' watermark has passed are reported.
    """
    stream = custom.replay_table(spark, events(spark, sf_dir), None, 5 * 24 * HOUR, "panewise_events")
    sink = FolderSink(new_path(spark, "replay-out"))
    job = Pipeline.create(spark, _config("slicing").build()).read_from(stream).start(sink)
    while job.query.isActive and (job.query.lastProgress is None or job.query.lastProgress.batchId < 1):
        time.sleep(0.05)
    job.restart()
    job.query.processAllAvailable()
    job.cancel()
    return sinks.aggregated(sink.read(spark))


def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): what the text sink has written."""
    path = new_path(spark, "text")
    Pipeline.create(spark, _config("slicing").build()).read_from(events(spark, sf_dir)).run(sinks.TextSink(path))
    return spark.read.text(path).select(F.col("value").alias("line"))


def sink_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a background job gave to a collector: a result for each window and query."""
    found: list[tuple] = []
    chain = Pipeline.create(spark, _config("pmcod_net").build()).read_from(events(spark, sf_dir))
    job = chain.start(sinks.CollectorSink(lambda end, key, n: found.append((end, key["R"], key["k"], key["w"], key["s"], n))))
    job.result()
    return spark.createDataFrame(found, RESULTS)


def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(status, slides) of a bounded job."""
    job = Pipeline.create(spark, _config("pmcod").build()).read_from(events(spark, sf_dir)).start(FolderSink(new_path(spark, "job")))
    slides = job.result().slides
    return spark.createDataFrame([(job.status, slides)], "status string, slides long")


QUERIES: dict[str, Query] = {
    "chain_command_line": command_line,
    "chain_tree_file": tree_file,
    "chain_tree_file_owners": tree_file_owners,
    "chain_users_source": users_source,
    "chain_users_partitioner": users_partitioner,
    "stream_users_partitioner": stream_users_partitioner,
    "chain_users_detector": users_detector,
    "chain_state_between_windows": state_between_windows,
    "chain_list_source": list_source,
    "chain_job_statistics": job_statistics,
    "sink_text": sink_text,
    "sink_collector": sink_collector,
    "stream_list_replay": list_replay,
    "stream_windows": stream_windows,
    "stream_stateful": stream_stateful,
    "stream_users_function": stream_users_function,
    "chain_combined_function": combined_function,
    "stream_combined_function": stream_combined_function,
    "stream_state_between_windows": stream_state_between_windows,
    "stream_table_replay": stream_table_replay,
    "stream_slicing": stream_strategy("slicing"),
    "stream_pmcod": stream_strategy("pmcod"),
    "stream_pmcod_net": stream_strategy("pmcod_net", grid=False),
    "stream_amcod": stream_strategy("amcod", RK),
    "stream_sop": stream_strategy("sop", RKWS),
    "stream_psod": stream_strategy("psod", RKWS, grid=False),
    "stream_pmcsky": stream_strategy("pmcsky", RKWS),
    "stream_advanced": stream_strategy("advanced"),
}

_NEWCOMERS_SQL = f"""WITH {_EVENTS}, x AS (SELECT t, unnest(range((t // {6 * HOUR} + 1) * {6 * HOUR}, t + {24 * HOUR} + 1, {6 * HOUR})) AS e FROM p)
SELECT e AS window_end, 0.0::DOUBLE AS R, 0 AS k, {24 * HOUR}::BIGINT AS w, {6 * HOUR}::BIGINT AS s, count(*) FILTER (t >= e - {6 * HOUR}) AS outliers FROM x GROUP BY 1"""
_RARE_SQL = f"""WITH {_EVENTS}, ws(w) AS (VALUES {', '.join(f'({w})' for w in RKWS.windows)}), ss(s) AS (VALUES {', '.join(f'({s})' for s in RKWS.slides)}), ks(k) AS (VALUES {', '.join(f'({k})' for k in RKWS.ks)}),
x AS (SELECT w, floor(v[1]) AS b, unnest(range((t // {RKWS.slide} + 1) * {RKWS.slide}, t + w + 1, {RKWS.slide})) AS e FROM p, ws), n AS (SELECT w, e, b, count(*) AS n FROM x GROUP BY ALL)
SELECT e AS window_end, 1.0::DOUBLE AS R, k, w::BIGINT AS w, s::BIGINT AS s, (coalesce(sum(n) FILTER (n < k), 0))::BIGINT AS outliers FROM n, ks, ss WHERE e % s = 0 GROUP BY ALL"""
_NATIONS = "p AS (SELECT n_nationkey AS id, n_nationkey AS t, [n_regionkey::DOUBLE] AS v FROM nation)"

SQL: dict[str, str] = {
    "chain_command_line": detect_sql(_EVENTS.replace("epoch_us(ts) // 1000", "event_id"), BY_ID, 1),
    "chain_tree_file": PLAIN_SQL["outliers_single_slicing"],
    "chain_users_partitioner": PLAIN_SQL["outliers_single_slicing"],
    "stream_users_partitioner": PLAIN_SQL["outliers_single_slicing"],
    "chain_tree_file_owners": "SELECT event_id AS id, 1 AS owners FROM events",
    "chain_users_source": f"SELECT * FROM ({detect_sql(_EVENTS[:-1] + ' WHERE event_id % 2 = 0)', RKWS, 1)}) WHERE k > 3",
    "chain_users_detector": detect_sql(_EVENTS[:-1] + " WHERE value < 50)", RKWS, 1),
    "chain_state_between_windows": _NEWCOMERS_SQL,
    "stream_state_between_windows": _NEWCOMERS_SQL,
    "chain_combined_function": _RARE_SQL,
    "stream_combined_function": _RARE_SQL,
    "stream_table_replay": f"SELECT * FROM ({PLAIN_SQL['outliers_single_slicing']}) WHERE window_end <= ((SELECT max(epoch_us(ts) // 1000) FROM events) - {SINGLE.slide}) // {SINGLE.slide} * {SINGLE.slide}",
    "chain_list_source": detect_sql(_NATIONS, QuerySet.of(NATIONS.ks, NATIONS.ranges, 10, 5), 1),
    "chain_job_statistics": f"WITH {_EVENTS}, x AS (SELECT DISTINCT unnest(range((t // {6 * HOUR} + 1) * {6 * HOUR}, t + {24 * HOUR} + 1, {6 * HOUR})) AS e FROM p) SELECT 'done' AS status, count(*) AS slides FROM x",
    "sink_text": PLAIN_SQL["format_print"],
    "sink_collector": PLAIN_SQL["outliers_single_slicing"],
    "stream_list_replay": "SELECT n_nationkey AS id, n_regionkey::DOUBLE AS v, n_nationkey AS arrival, 0 AS flag FROM nation",
    "stream_windows": detect_sql(_EVENTS, RKWS, 1),
    "stream_stateful": PLAIN_SQL["outliers_single_slicing"],
    "stream_users_function": PLAIN_SQL["outliers_user_defined"],
    **{f"stream_{name}": PLAIN_SQL["outliers_single_slicing"] for name in ("slicing", "pmcod", "pmcod_net", "advanced")},
    **{f"stream_{name}": detect_sql(_EVENTS, RKWS, 1) for name in ("sop", "psod", "pmcsky")},
    "stream_amcod": detect_sql(_EVENTS, RK, 1),
}
