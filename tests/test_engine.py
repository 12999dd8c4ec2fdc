"""Detection against brute force: strategies, query sets, partitioners, neighbour search."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panewise.config import Algorithm, QuerySet, Space
from panewise.errors import ConfigError, PartitioningError, UnsupportedSpaceError
from panewise.operators import evidence, neighbours, partitioning
from panewise.plans import counting, strategies
from panewise.sources import points as sources


def brute(points, q):
    """{(window_end, R, k, w, s): outliers} by the definition."""
    out = {}
    for w in q.windows:
        for s in q.slides:
            ends = sorted({e for _, _, t, *_ in points for e in range((t // s + 1) * s, t + w + 1, s)})
            for e in ends:
                live = [(i, v) for i, v, t, *_ in points if e - w <= t < e]
                for r in q.ranges:
                    n = [sum(j != i and math.sqrt(sum((a - b) ** 2 for a, b in zip(v, u))) <= r for j, u in live) for i, v in live]
                    for k in q.ks:
                        out[e, r, k, w, s] = sum(c < k for c in n)
    return out


def counted(df):
    rows = df.collect()
    found = {(r.window_end, r.R, r.k, r.w, r.s): r.outliers for r in rows}
    assert len(found) == len(rows)
    return found


def each(function, names):
    """{name: function(name)}, some at a time: small plans wait more than they work."""
    with ThreadPoolExecutor(5) as pool:
        return dict(zip(names, pool.map(function, names)))


def random_points(n, d, seed, span=60, lattice=True):
    rng = random.Random(seed)
    value = lambda: rng.randint(-4, 4) / 2 if lattice else rng.gauss(0, 2)
    return [(i - n // 3, [value() for _ in range(d)], rng.randint(0, span) + (200 if rng.random() < 0.1 else 0)) for i in range(n)]


SETS = {
    "single": QuerySet.of(3, 1.0, 20, 5),
    "uneven": QuerySet.of(2, 0.5, 14, 4),
    "rk": QuerySet.of([1, 4, 2], [1.5, 0.5, 1.0, 0.5], 20, 5),
    "rkws": QuerySet.of([1, 3], [0.5, 1.5], [8, 20], [4, 6]),
}


@pytest.mark.parametrize(("kind", "d"), [("single", 3), ("uneven", 1), ("rk", 1), ("rkws", 3)])
def test_every_strategy_counts_as_the_definition(spark, kind, d):
    points = random_points(70, d, seed=d)
    table, q = sources.from_list(spark, points), SETS[kind]
    want = brute(points, q)
    asked = {a: s for a, s in strategies.STRATEGIES.items() if a is not Algorithm.PMCOD_NET or len(q.windows) == 1}
    found = each(lambda a: counted(asked[a](table, q)), asked)
    for algorithm in asked:
        assert found[algorithm] == want, algorithm


def test_edges_of_the_definition(spark):
    q = QuerySet.of(1, 2.0, 10, 5)
    for points in ([], [(1, [0.0], 0)], [(i, [7.0], 3) for i in range(6)], [(1, [0.0], 0), (2, [2.0], 9)], [(1, [0.0], 0), (2, [2.0], 10)], [(-5, [-1.0, 3.0], 4), (8, [-1.0], 4), (9, [-4.0, 3.0, 1.0], 4)]):
        want = brute(points, q)
        names = (Algorithm.SLICING, Algorithm.PMCOD, Algorithm.PSOD, Algorithm.ADVANCED, Algorithm.NAIVE)
        for name, found in each(lambda a: counted(strategies.STRATEGIES[a](sources.from_list(spark, points), q)), names).items():  # noqa: B023
            assert found == want, (name, points)


def test_dense_cells_at_and_above_k(spark):
    q = QuerySet.of(4, 1.0, 10, 5)
    for n in (4, 5, 6):
        points = [(i, [0.1], i) for i in range(n)] + [(100, [0.9], 2), (101, [50.0], 3)]
        names = (Algorithm.PMCOD, Algorithm.PMCOD_NET, Algorithm.AMCOD, Algorithm.PMCSKY)
        for found in each(lambda a: counted(strategies.STRATEGIES[a](sources.from_list(spark, points), q)), names).values():  # noqa: B023
            assert found == brute(points, q)


def test_the_reported_windows_of_a_long_stream(spark):
    """Ids 0 to 299,999 as times, windows of 10,000 every 500: 619 ends from 500 to 309,500."""
    q = QuerySet.of(50, 0.45, 10_000, 500)
    points = spark.range(300_000).select("id", F.array(F.lit(1.0)).alias("value"), F.col("id").alias("arrival"), F.lit(0).alias("flag"))
    found = evidence.window_grid(points, q).toPandas().set_index("window_end")["points"]
    assert len(found) == 619 and found.index.min() == 500 and found.index.max() == 309_500
    assert found[500] == 500 and found[10_000] == 10_000 and found[309_500] == 500


def test_outliers_themselves(spark):
    points, q = random_points(60, 2, seed=9), SETS["rk"]
    rows = counting.outlier_points(sources.from_list(spark, points), q)
    found = {(r.window_end, r.R, r.k, r.w, 5): r["count"] for r in rows.groupBy("window_end", "R", "k", "w").count().collect()}
    assert found == {k: v for k, v in brute(points, q).items() if v}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=3), st.lists(st.integers(1, 40), min_size=1, max_size=3))
def test_panes_divide_windows_and_slides(windows, slides):
    q = QuerySet.of(1, 1.0, windows, slides)
    assert all(w % q.pane == 0 for w in q.windows) and all(s % q.pane == 0 for s in q.slides) and q.slide % q.pane == 0


def own_grid(r=0.0):
    return partitioning.Grid(((-1.0, 0.5), (0.0,)), start=3)


PARTITIONERS = {
    "replication": partitioning.Replication(5),
    "grid": own_grid(),
    "even": None,
    "tree": "tree",
    "column": partitioning.ByColumn(lambda i, v, r: F.transform(F.sequence(F.floor(v[0] - r), F.floor(v[0] + r)), lambda c: F.struct(F.pmod(c, F.lit(50)).cast("int").alias("partition"), F.when(c == F.floor(v[0]), 0).otherwise(1).alias("flag")))),
}


@pytest.mark.parametrize("name", PARTITIONERS)
def test_a_partitioner_changes_no_count(spark, name):
    points, q = random_points(80, 2, seed=4, lattice=False), SETS["single"]
    table = sources.from_list(spark, points)
    chosen = PARTITIONERS[name]
    if name == "even":
        chosen = partitioning.even_grid(table, 1.0, 4)
    elif name == "tree":
        chosen = partitioning.VPTree.fit([v for _, v, _ in points[:30]], 8)
    parted = partitioning.checked(chosen.partition(table, q.max_range))
    assert parted.where("flag = 0").count() == len(points) and parted.groupBy("id", "partition").count().where("count > 1").count() == 0
    assert counted(strategies.advanced_extended(table, q, chosen.partition)) == brute(points, q)


def test_a_function_deals_points(spark):
    def deal(identity, value, r, state):
        state.included_in(int(value[0] > 0))
        state.included_flagged_in(1 - int(value[0] > 0))

    points = sources.from_list(spark, [(1, [2.0], 0), (-2, [-2.0], 0)])
    found = partitioning.ByFunction(deal).partition(points, 1.0)
    assert {(r.id, r.partition, r.flag) for r in found.collect()} == {(1, 1, 0), (1, 0, 1), (-2, 0, 0), (-2, 1, 1)}
    with pytest.raises(PartitioningError):
        partitioning.checked(partitioning.ByFunction(lambda i, v, r, s: s.included_flagged_in(0)).partition(points, 1.0))
    assert {r.partition for r in partitioning.Replication(4).partition(points, 1.0).where("flag = 0").collect()} == {1, 2}


def test_presets_cover_all_values(spark):
    points = sources.from_list(spark, [(i, [v, 81.0, 26.9], 0) for i, v in enumerate([-5.0, 0.0, 87.231, 99.9, 500.0])])
    stk = partitioning.preset("STK").partition(points, 0.45)
    assert {r.id: r.partition for r in stk.where("flag = 0").collect()} == {0: 0, 1: 0, 2: 1, 3: 7, 4: 15}
    tao = partitioning.preset("tao").partition(points, 1.9)
    assert partitioning.checked(tao).where("id = 0").groupBy("flag").count().orderBy("flag").collect() == [(0, 1), (1, 5)]
    assert partitioning.preset("other") is None


def test_unusable_partitioners():
    for make in (lambda: partitioning.Grid(((2.0, 1.0),)), lambda: partitioning.Grid(()), lambda: partitioning.VPTree.fit([[1.0]], 6), lambda: partitioning.VPTree.fit([], 4)):
        with pytest.raises(PartitioningError):
            make()


def test_neighbour_search(spark):
    points = random_points(60, 2, seed=11)
    table = sources.from_list(spark, points)
    want = {i: sorted((math.dist(v, u), j) for j, u, _ in points if j != i) for i, v, _ in points}
    near = neighbours.range_neighbours(table, 1.0)
    assert {(r.id, r.other) for r in near.collect()} == {(i, j) for i, x in want.items() for d, j in x if d <= 1.0}
    for found, keep in ((neighbours.nearest(table, 4, table.where("id % 3 = 0")), lambda i, x: i % 3 == 0 and x[:4]), (neighbours.range_limit(table, 1.0, 2), lambda i, x: [y for y in x if y[0] <= 1.0][:2])):
        got = {}
        for r in found.orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.distance, r.other))
        assert got == {i: kept for i, x in want.items() if (kept := keep(i, x))}
    with pytest.raises(ConfigError):
        neighbours.nearest(table, 0)
    assert neighbours.nearest(table.limit(1), 3).count() == 0


def test_evidence(spark):
    q = SETS["single"]
    points = [(i, [0.0], 2 * i) for i in range(12)]
    table = sources.from_list(spark, points)
    latest = evidence.latest_predecessors(table, q, 2).where("id = 6").orderBy("rank").collect()
    assert [r.other for r in latest] == [5, 4]
    assert {r.id for r in evidence.safe_inliers(table, q).collect()} == set(range(9))
    schedule = evidence.report_schedule(table, QuerySet.of(1, 1.0, 10, [4, 6])).collect()
    assert {(r.window_end, r.s) for r in schedule if r.window_end == 12} == {(12, 4), (12, 6)}


def test_detectors_of_a_user(spark):
    points, q = random_points(50, 1, seed=2), SETS["single"]
    table = sources.from_list(spark, points)

    class Mine(strategies.Detector):
        def transform(self, points):
            return points.where("id % 2 = 0")

        def detect(self, points, queries):
            return counting.detect(points, queries)

    assert counted(Mine()(table, q)) == brute([p for p in points if p[0] % 2 == 0], q)
    with pytest.raises(UnsupportedSpaceError):
        Mine()(table, SETS["rk"])

    def function(end, w, rows):
        x = rows["value"].str[0].to_numpy()
        n = [(abs(x - v) <= 1.0).sum() - 1 for v in x]
        return pd.DataFrame({"R": [1.0], "k": [3], "outliers": [sum(c < 3 for c in n)]})

    assert counted(strategies.by_window(function)(table, q)) == brute(points, q)
    assert Space.of("RK") is Space.RK
