"""Custom and paced sources, sinks that get a batch again, state between windows, job handles, counting by value."""

from __future__ import annotations

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panewise import sinks
from panewise.config import OutlierConfig, QuerySet
from panewise.pipeline import Pipeline
from panewise.plans import counting, strategies
from panewise.sources import custom
from panewise.sources import points as sources
from tests.test_engine import brute, counted, own_grid, random_points
from tests.test_parts import _streamed


class Batches(custom.StreamSource):
    """Gives its points in three parts."""

    def __init__(self, points, mark):
        self.parts, self.mark = [points[0::3], points[1::3], points[2::3]], mark

    def available_items(self):
        return self.parts.pop(0)

    def is_complete(self):
        return not self.parts

    def close(self):
        with open(self.mark, "a") as file:
            file.write("closed\n")


def test_a_users_source(spark, tmp_path):
    points = [(i, [float(i)], i * 10) for i in range(20)]
    mark = str(tmp_path / "mark")
    stream = custom.read_custom(spark, lambda: Batches(points, mark), "own_batches")
    query = stream.writeStream.format("memory").queryName("own_batches").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("own_batches").collect()) == [(i, v, t, 0) for i, v, t in points]
    assert open(mark).read() == "closed\n"


def test_arrivals_set_the_pace():
    now = [100.0]
    paced = custom.Paced([(1, [0.0], 5000), (2, [0.0], 5400), (3, [0.0], 9000)], speed=2.0, clock=lambda: now[0])
    assert [p[0] for p in paced.available_items()] == [1] and not paced.available_items()
    now[0] += 0.2
    assert [p[0] for p in paced.available_items()] == [2] and not paced.is_complete()
    now[0] += 2
    assert [p[0] for p in paced.available_items()] == [3] and paced.is_complete() and paced.available_items() == []
    steps = custom.Paced([(i, [0.0], 1000 * i) for i in range(6)], speed=None, step=2000)
    assert [[p[0] for p in steps.available_items()] for _ in range(3)] == [[0, 1, 2], [3, 4], [5]]
    assert custom.Paced([]).is_complete()


def test_a_batch_can_be_read_again():
    reader = custom._Reader(custom.Paced([(i, [0.0], i) for i in range(5)], speed=None, step=2))
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == [0, 1, 2] == [r[0] for r in reader.readBetweenOffsets({"points": 0}, end)]
    reader.commit(end)
    rows, last = reader.read(end)
    assert [r[0] for r in rows] == [3, 4] and last == {"points": 5}
    assert [r[0] for r in reader.readBetweenOffsets({"points": 4}, last)] == [4]


def test_replayed_points_are_detected(spark, tmp_path):
    points = [(i, v, t + 10_000) for i, v, t in random_points(50, 1, seed=4, span=40)]
    q = QuerySet.of(2, 1.0, 20, 5)
    c = OutlierConfig.builder().for_algorithm("pmcod").in_single_space().querying(2, 1.0, 20, 5).build()
    last = [(10**6, [1e9], 10**6), (10**6 + 1, [2e9], 2 * 10**6)]
    found = {}
    sink = sinks.CollectorSink(lambda end, key, n: found.update({(end, key["R"], key["k"], key["w"], key["s"]): n}))
    job = Pipeline.create(spark, c).read_from(custom.replay(spark, points + last, None, 10**7, "own_replay")).start(sink, checkpointLocation=str(tmp_path / "c"))
    job.query.processAllAvailable()
    assert job.status == "running"
    job.cancel()
    assert job.wait(60) and job.status == "done" and job.statistics.rows == 52 and job.statistics.slides >= len(brute(points, q))
    assert {k: n for k, n in found.items() if k[0] < 500_000} == brute(points, q)


RESULTS = "window_end long, R double, k int, w long, s long, outliers long"


class Seen(sinks.Sink):
    """Notes what it is given."""

    def __init__(self):
        self.rows = []

    def write_batch(self, rows):
        self.rows += [(r["window_end"], r["outliers"]) for r in rows.collect()]


def _results_stream(spark, folder, numbers):
    spark.createDataFrame([(n, 0.5, 3, 20, 5, n) for n in numbers], RESULTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(RESULTS).parquet(folder)


def test_one_sink_serves_two_streams(spark, tmp_path):
    sink = Seen()
    for k in (1, 2):
        query = sink.write(_results_stream(spark, str(tmp_path / f"in{k}"), [k, 10 * k]))
        query.processAllAvailable()
        query.stop()
    assert sorted(sink.rows) == [(1, 1), (2, 2), (10, 10), (20, 20)]


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    """Spark repeats a batch whose commit is missing; a new sink, as in a new process, is not given it again. A broken one is."""
    log, folder = str(tmp_path / "log"), str(tmp_path / "in")
    stream = _results_stream(spark, folder, [1])
    text = sinks.TextSink(str(tmp_path / "text"))

    class Broken(Seen):
        def write_batch(self, rows):
            raise RuntimeError("no connection")

    broken = Broken().write(stream, checkpointLocation=log)
    with pytest.raises(Exception):
        broken.processAllAvailable()
    for number, sink, want in ((1, Seen(), [(1, 1)]), (2, Seen(), [(2, 2)]), (None, Seen(), [])):
        if number == 2:
            _results_stream(spark, folder, [2])
        if number is None:  # as if the process had died between writing and Spark's commit
            last = max((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            (tmp_path / "log" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
        query = sink.write(stream, checkpointLocation=log)
        query.processAllAvailable()
        query.stop()
        assert sink.rows == want
    query = text.write(stream, checkpointLocation=str(tmp_path / "log2"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == ["1;(20,5,0.5,3);1", "2;(20,5,0.5,3);2"]


def test_a_restarted_users_source_goes_on_counting(tmp_path):
    reader = custom._Reader(custom.Paced([(i, [0.0], i) for i in range(3)], speed=None, step=10))
    rows, end = reader.read({"points": 1000})
    assert [r[0] for r in rows] == [0, 1, 2] and end == {"points": 1003}
    reader.commit(end)
    assert reader.kept == [] and reader.first == 1003


def test_a_partitioned_source_is_read_by_tasks_and_restarts(spark, tmp_path):
    points = random_points(200, 2, seed=3, span=100)
    stream = custom.replay_table(spark, sources.from_list(spark, points).repartition(3), None, 7, "own_replay_table")
    rows = []
    each = lambda df, n: rows.append((n, sorted(r["id"] for r in df.collect()), df.rdd.getNumPartitions()))
    start = lambda: stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).start()
    query = start()
    while not rows or rows[-1][0] < 3:
        time.sleep(0.02)
    query.stop()
    query = start()
    query.processAllAvailable()
    query.stop()
    by_batch = dict((n, ids) for n, ids, _ in rows)
    assert sorted(i for ids in by_batch.values() for i in ids) == sorted(p[0] for p in points) and len(by_batch) > 5
    times = {p[0]: p[2] for p in points}
    order = [(min(map(times.get, ids)), max(map(times.get, ids))) for _, ids in sorted(by_batch.items()) if ids]
    assert all(a[1] < b[0] for a, b in zip(order, order[1:]))


def test_a_job_is_suspended_resumed_and_copied(spark, tmp_path):
    points = sorted(((i, v, t + 10_000) for i, v, t in random_points(60, 1, seed=5, span=60)), key=lambda p: p[2])
    c = OutlierConfig.builder().for_algorithm("pmcod").in_single_space().querying(2, 1.0, 20, 5).build()
    folder, last = str(tmp_path / "in"), [(10**6, [1e9], 10**6), (10**6 + 1, [2e9], 2 * 10**6)]
    put = lambda part: sources.from_list(spark, part).coalesce(1).write.mode("append").parquet(folder)
    put(points[:30])
    chain, sink = Pipeline.create(spark, c).read_from(sources.replayed(spark, folder)), sinks.TextSink(str(tmp_path / "out"))
    job = chain.start(sink)
    job.query.processAllAvailable()
    job.suspend()
    assert job.status == "suspended" and job.statistics.rows == 30
    put(points[30:])
    job.resume()
    assert job.status == "running"
    job.query.processAllAvailable()
    copied, other = job.snapshot(str(tmp_path / "snapshot")), sinks.TextSink(str(tmp_path / "other"))
    assert job.status == "running"
    put(last[:1])
    job.query.processAllAvailable()
    put(last[1:])
    job.query.processAllAvailable()
    job.cancel()
    assert job.status == "done"
    want, stats = brute(points, QuerySet.of(2, 1.0, 20, 5)), job.statistics
    assert stats.rows == 62 and stats.slides >= len(want) and stats.cpu_seconds > 0 and stats.compared > 0 and stats.ms_per_slide > 0
    again = chain.resume_from(copied, other)
    again.query.processAllAvailable()
    again.cancel()
    lines = lambda p: sorted(r["value"] for r in spark.read.text(str(p)).collect() if int(r["value"].split(";")[0]) < 500_000)
    found = lines(tmp_path / "out")
    assert found == sorted(f"{e};({w},{s},{r},{k});{n}" for (e, r, k, w, s), n in want.items())
    assert lines(tmp_path / "other") and set(lines(tmp_path / "other")) <= set(found)


def _growth(end, w, table, state):
    """Outliers: points whose id no earlier window of the same length has had."""
    old = set(state.get(str(w), []))
    new = [int(i) for i in table["id"] if int(i) not in old]
    state[str(w)] = sorted(old | set(new))
    return pd.DataFrame({"R": [0.0], "k": [0], "outliers": [len(new)]})


def test_state_lasts_from_window_to_window(spark, tmp_path):
    points = [(i, v, t + 10_000) for i, v, t in random_points(50, 2, seed=9, span=40)]
    q = QuerySet.of(2, 1.0, [10, 20], 5)
    strategy = strategies.by_window(_growth, state=True)
    want = counted(strategy(sources.from_list(spark, points), q))
    assert {w: sum(n for k, n in want.items() if k[3] == w) for w in (10, 20)} == {10: 50, 20: 50}
    assert {k: n for k, n in _streamed(spark, tmp_path, points, q, strategy).items() if n} == {k: n for k, n in want.items() if n}
    parted = own_grid().partition(sources.from_list(spark, points), 1.0).where("flag = 0")
    assert sum(r["outliers"] for r in strategy(parted, q).where("w = 10").collect()) == 50
    assert strategy(sources.from_list(spark, []), q).count() == 0


def test_handle_of_a_bounded_job(spark):
    points = random_points(40, 1, seed=2, span=30)
    c = OutlierConfig.builder().for_algorithm("slicing").in_single_space().querying(2, 1.0, 20, 5).build()
    chain, found = Pipeline.create(spark, c).read_from(sources.from_list(spark, points)), []
    job = chain.start(sinks.CollectorSink(lambda end, key, n: found.append(end)))
    assert job.result().slides == len(found) and job.status == "done" and job.statistics.ms_per_slide > 0
    slow = F.udf(lambda x: time.sleep(1) or x, "long")
    late = chain.transform(lambda p: p.withColumn("id", slow("id"))).start(sinks.CollectorSink(lambda *_: None))
    time.sleep(3)
    assert late.status == "running"
    late.cancel()
    assert late.wait(50) and late.status == "cancelled"
    with pytest.raises(Exception):
        late.result()


@pytest.mark.parametrize("q", [QuerySet.of(3, 1.5, 20, 5), QuerySet.of([2, 5, 40], [0.5, 1.5, 2.3], [10, 20], [5, 10])])
def test_few_values_are_counted_as_values(spark, q):
    points = [(i, [float(i * 7 % 5), float(i % 3)], i * 13 % 60) for i in range(200)] + [(900 + i, [9.0 + 4 * i, 9.0], 7 * i) for i in range(5)]
    table = sources.from_list(spark, points)
    want = brute(points, q)
    assert counted(strategies.by_value(table, q)) == counted(strategies.pmcod(table, q)) == want
    assert strategies.by_value(table.limit(0), q).count() == 0
