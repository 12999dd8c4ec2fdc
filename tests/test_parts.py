"""Configuration, sources, sinks, pipeline, streams and the driver's entry."""

from __future__ import annotations

import http.server
import subprocess
import sys
import threading
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panewise import queries, sinks
from panewise.config import Algorithm, OutlierConfig, Output, Partitioning, QuerySet, Space, truth
from panewise.errors import ConfigError, ParseError, UnsupportedSpaceError
from panewise.pipeline import Pipeline
from panewise.plans import counting, strategies
from panewise.sources import points as sources
from panewise.streaming import stateful, windows
from tests.test_engine import brute, counted, own_grid, random_points


def config(**more):
    b = OutlierConfig.builder().for_algorithm(more.get("algorithm", "pmcod")).in_single_space().querying(3, 1.0, 20, 5).for_dataset_named("points.txt")
    return b


def test_builder_and_validation():
    c = config().located_in("/data").grid_partitioned(own_grid()).printing_outliers().enabling_debug().build()
    assert (c.algorithm, c.space, c.partitioning, c.output, c.debug) == (Algorithm.PMCOD, Space.SINGLE, Partitioning.GRID, Output.PRINT, True)
    assert (c.queries.pane, c.queries.slide, c.queries.lateness) == (5, 5, 5)
    with pytest.raises(ConfigError, match="grid"):
        config().grid_partitioned().build()
    with pytest.raises(ConfigError, match="replication"):
        config().replication_partitioned().build()
    with pytest.raises(ConfigError, match="replication"):
        config(algorithm="naive").tree_partitioned("f").build()
    with pytest.raises(UnsupportedSpaceError):
        config(algorithm="sop").build()
    with pytest.raises(UnsupportedSpaceError):
        OutlierConfig.builder().for_algorithm("sop").in_rk_space().querying([1], [1.0], [5, 10], 5).build()
    with pytest.raises(ConfigError, match="not set"):
        OutlierConfig.builder().build()
    for bad in ((0, 1.0, 5, 5), (1, -1.0, 5, 5), (1, 1.0, [], 5), (1, 1.0, 5, 0)):
        with pytest.raises(ConfigError):
            QuerySet.of(*bad)
    assert QuerySet.of([5, 3, 5], 1, 4, 4).ks == (3, 5)


def test_command_line(monkeypatch):
    monkeypatch.setenv("JOB_INPUT", "/in")
    monkeypatch.setenv("INFLUXDB_HOST", "h:1")
    args = "--space rk --algorithm amcod --W 10 --S 5 --k 3;5 --R 0.5;1.5 --dataset stk --partitioning grid --debug yes".split()
    c = OutlierConfig.from_args(args)
    assert c.queries == QuerySet.of([3, 5], [0.5, 1.5], 10, 5) and c.home == "/in" and c.sink_options == {"host": "h:1"} and c.debug
    for bad in (args[:-4], [*args, "--tree_init", "5"], [*args, "--odd", "1"], ["--space", "x"]):
        with pytest.raises(ConfigError):
            OutlierConfig.from_args(bad)
    assert truth(" T ") and not truth("no")
    with pytest.raises(ConfigError):
        truth("perhaps")


def test_text_points(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1&1.5, 2\n\nx&1\n-3&bad,4.0\n4&bad\n5\n9&1e3&2\n")
    found = {r.id: (r.value, r.arrival, r.flag) for r in sources.read_text(spark, str(tmp_path / "a.txt")).collect()}
    assert found == {1: ([1.5, 2.0], 1, 0), -3: ([None, 4.0], -3, 0)}
    with pytest.raises(Exception, match="no point: x&1"):
        sources.read_text(spark, str(tmp_path / "a.txt"), mode="failfast").collect()
    assert sources.sample_values(spark, str(tmp_path / "a.txt"), 10, value="&") == [[5.0], [9.0, 1000.0, 2.0]]
    with pytest.raises(ConfigError):
        sources.read_text(spark, str(tmp_path), mode="other")
    with pytest.raises(ParseError):
        sources.from_list(spark, [(1, "x", 2)])


def test_messages(spark):
    rows = ['{"id":1,"timestamp":500,"value":[1.0,2.0]}', '{"id":2,"value":[1.0]}', "no json", None]
    found = sources.from_json(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r.id, r.value, r.arrival, r.flag) for r in found] == [(1, [1.0, 2.0], 500, 0)]


def test_sinks(spark, tmp_path):
    results = spark.createDataFrame([(500, 0.45, 50, 10000, 500, 400), (500, 0.45, 50, 10000, 500, 32)], "window_end long, R double, k int, w long, s long, outliers long")
    sinks.TextSink(str(tmp_path / "o")).write(results)
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["500;(10000,500,0.45,50);432"]
    got, closed = [], []
    sinks.CollectorSink(lambda *x: got.append(x), lambda: closed.append(1)).write(results)
    assert got == [(500, {"R": 0.45, "k": 50, "w": 10000, "s": 500}, 432)] and closed == [1]
    sinks.PrintSink().write(results)
    bodies = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            bodies.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode(), self.headers["Authorization"]))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *x):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sinks.InfluxDBSink(f"127.0.0.1:{server.server_port}", "d", "u", "p").write(results)
    server.shutdown()
    assert bodies == [("/write?db=d&precision=ms", "outliers,R=0.45,S=500,W=10000,k=50 Outliers=432i 500", "Basic dTpw")]


def test_pipeline_of_a_file(spark, tmp_path):
    points = [(i, v, i) for i, v, _ in random_points(80, 1, seed=5) if i >= 0]
    (tmp_path / "points.txt").write_text("".join(f"{i}&{','.join(map(str, v))}\n" for i, v, _ in points))
    (tmp_path / "sample.txt").write_text("".join(f"{v[0]}\n" for _, v, _ in points[:20]))
    want = brute(points, QuerySet.of(3, 1.0, 20, 5))
    for algorithm, part in (("naive", lambda b: b.replication_partitioned(4)), ("advanced_extended", lambda b: b.grid_partitioned(own_grid_1d())), ("slicing", lambda b: b.tree_partitioned(str(tmp_path / "sample.txt"), 20, 4)), ("pmcod", lambda b: b.user_partitioned(lambda i, v, r, s: s.included_in(0)))):
        chain = Pipeline.create(spark, part(config(algorithm=algorithm).located_in(str(tmp_path))).enabling_debug().build())
        assert counted(chain.read_data().partition().detect_outliers().aggregate()) == want, algorithm
    got = []
    stats = chain.run(sinks.CollectorSink(lambda *x: got.append(x)))
    assert len(got) == len(want) == stats.slides and stats.ms_per_slide > 0
    chain = Pipeline.create(spark, OutlierConfig.builder().user_defined(counting.detect).in_single_space().querying(3, 1.0, 20, 5).build())
    table = spark.createDataFrame([(i, v[0], t) for i, v, t in points], "a long, b double, c long")
    assert counted(chain.from_table(table, "a", ["b"], "c").transform(lambda df: df.where("id >= 0")).detect_outliers().aggregate()) == want
    with pytest.raises(ConfigError):
        chain.detect_outliers()


def own_grid_1d():
    from panewise.operators.partitioning import Grid

    return Grid(((-1.0, 0.0, 1.0),))


def _streamed(spark, tmp_path, points, q, detect, partition=None):
    """The counts that a stream gives for points in order of time, three files, and a last far one that closes all windows."""
    points = sorted(points, key=lambda p: p[2])
    third = len(points) // 3 + 1
    for k, part in enumerate([points[:third], points[third : 2 * third], points[2 * third :], [(10**6, [1e9] * len(points[0][1]), 10**6)], [(10**6 + 1, [2e9] * len(points[0][1]), 10**6 + 1)]]):
        folder = tmp_path / f"f{k}"
        sources.from_list(spark, part).coalesce(1).write.parquet(str(folder))
        target = tmp_path / "in" / f"{k}.parquet"
        target.parent.mkdir(exist_ok=True)
        next(folder.glob("part-*.parquet")).rename(target)
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = sources.replayed(spark, str(tmp_path / "in"))
    stream = partition(stream) if partition else stream
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = detect(stream, q).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    return counted(sinks.aggregated(spark.table(name)).where("window_end < 500000"))


@pytest.mark.parametrize("detect", [windows.detect_stream, stateful.detect_stateful])
def test_streams_count_as_tables(spark, tmp_path, detect):
    points = [(i, v, t + 10_000) for i, v, t in random_points(60, 2, seed=6, span=60)]
    q = QuerySet.of([2, 4], [0.5, 1.0], [10, 20], [5, 10])
    want = brute(points, q)
    assert _streamed(spark, tmp_path, points, q, detect) == want


def test_a_partitioned_stream(spark, tmp_path):
    points = [(i, v, t + 10_000) for i, v, t in random_points(60, 2, seed=8, span=40)]
    q = QuerySet.of(3, 1.0, 20, 5)
    assert _streamed(spark, tmp_path, points, q, windows.detect_stream, lambda s: own_grid().partition(s, 1.0)) == brute(points, q)


def test_a_users_detector_on_a_stream(spark, tmp_path):
    points = [(i, v, t + 10_000) for i, v, t in random_points(50, 1, seed=3, span=40)]
    q = QuerySet.of([2, 4], 1.0, [9, 14], [4, 6])

    def function(end, w, rows):
        """Of ids divisible by 2 only, which no built-in strategy counts."""
        x = rows[rows["id"] % 2 == 0]["value"].str[0].to_numpy()
        n = [int((abs(x - v) <= 1.0).sum()) - 1 for v in x]
        return pd.DataFrame({"R": [1.0, 1.0], "k": [2, 4], "outliers": [sum(c < k for c in n) for k in (2, 4)]})

    b = OutlierConfig.builder().user_defined(strategies.by_window(function)).in_rkws_space().querying([2, 4], 1.0, [9, 14], [4, 6])
    detect = lambda stream, _: Pipeline.create(spark, b.build()).read_from(stream).detect_outliers().results
    found = _streamed(spark, tmp_path, points, q, detect)
    assert found == counted(strategies.by_window(function)(sources.from_list(spark, points), q))
    want = brute([p for p in points if p[0] % 2 == 0], q)
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}


def test_a_stream_of_a_user_defined_algorithm_needs_a_detector(spark, tmp_path):
    sources.from_list(spark, [(1, [0.0], 1)]).write.parquet(str(tmp_path / "in"))
    from dataclasses import replace

    given = OutlierConfig.builder().user_defined(counting.detect).in_single_space().querying(3, 1.0, 20, 5).build()
    with pytest.raises(ConfigError, match="detector"):
        Pipeline(spark, replace(given, detector=None)).read_from(sources.replayed(spark, str(tmp_path / "in"))).detect_outliers()


def test_print_leaves_no_line_out(spark, capsys):
    results = spark.range(10_050).select(F.col("id").alias("window_end"), F.lit(0.5).alias("R"), F.lit(3).alias("k"), F.lit(20).cast("long").alias("w"), F.lit(1).cast("long").alias("s"), F.col("id").alias("outliers"))
    sinks.PrintSink().write(results)
    assert [x for x in capsys.readouterr().out.splitlines() if ";(" in x] == [f"{i};(20,1,0.5,3);{i}" for i in range(10_050)]


def test_every_line_item_is_a_point(spark, tmp_path):
    """Rows that share their keys, and keys beyond what digits of one long hold."""
    import datetime

    day = datetime.datetime(2020, 1, 1)
    keys = [(10**12, 1, 5_000_000, 7)] * 3 + [(1, 1, 1_000_001, 7), (1, 2, 1, 7)]
    rows = [(*k, 1.0 + 9 * (n > 3), 0.0, 0.0, day) for n, k in enumerate(keys)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    points = queries.items(spark, str(tmp_path))
    assert points.count() == points.select("id").distinct().count() == 5
    assert points.collect() == points.collect()
    at = lambda r: int(day.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    assert counted(queries.QUERIES["outliers_3d"](spark, str(tmp_path))) == brute([(i, [r[4], 0.0, 0.0], at(r)) for i, r in enumerate(rows)], queries.ITEMS)


def test_entry_imports_alone(spark):
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['PACKAGE'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'outliers_single_pmcod' in q and not [n for n in q if n.startswith('op')]; assert set(o) <= set(q)"
    for package in ("panewise.llm.queries", "panewise.llm", "xxhash"):
        done = subprocess.run([sys.executable, "-c", code.replace("PACKAGE", package)], cwd=root, check=True, capture_output=True, text=True)
        assert "left out" in done.stderr


def test_nothing_imports_the_optional_part():
    root = Path(__file__).resolve().parents[1] / "panewise"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "panewise.llm" not in file.read_text(), file
