"""Many points of a value and time: results against brute force, and what they cost."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest

from panewise import chains
from panewise.config import Algorithm, QuerySet
from panewise.operators import evidence, neighbours
from panewise.pipeline import Pipeline
from panewise.plans import counting, strategies
from panewise.sinks import TextSink
from panewise.sources import points as sources
from panewise.streaming import evidence as E
from panewise.streaming.windows import counts_of
from tests.test_engine import brute, counted

SINGLE = QuerySet.of(9, 1.0, 20, 10)
RK = QuerySet.of([3, 9, 12], [0.5, 1.0], 20, 10)
RKWS = QuerySet.of([3, 9, 12], [0.5, 1.0], [10, 20], [10, 20])
#: Different values and times, and points of each.
DIFFERENT, COPIES = 24, 8


def crowd(copies=COPIES):
    rng = random.Random(5)
    base = [([rng.choice([3.0, 3.25, 4.5, 5.5, 40.0, 41.0, 55.0, 60.25])], rng.randint(0, 25)) for _ in range(DIFFERENT - 2)] + [([80.5], 3), ([-0.0], 7)]
    return [(1_000 * c + i, v, t) for c in range(copies) for i, (v, t) in enumerate(base)] + [(9_999, [70.0], 12)]


class Joined:
    """The tables of pairs that a plan has made."""

    def __init__(self, monkeypatch):
        self.tables = []
        pairs, pane_counts = counting.pairs, counting.pane_counts
        monkeypatch.setattr(counting, "pairs", lambda *a, **k: self.kept(pairs(*a, **k)))
        monkeypatch.setattr(counting, "pane_counts", lambda found, q: pane_counts(self.kept(found), q))

    def kept(self, found):
        self.tables.append(found)
        return found

    def few(self):
        return self.tables and all(t.count() <= (DIFFERENT + 1) ** 2 for t in self.tables)


DETECTED = {
    "rk_psod": (strategies.psod, RK),
    "rk_sop": (strategies.sop, RK),
    "rkws_psod": (strategies.psod, RKWS),
    "rkws_sop": (strategies.sop, RKWS),
    "naive": (strategies.naive, SINGLE),
    "advanced": (strategies.advanced, SINGLE),
    "advanced_extended": (strategies.advanced_extended, SINGLE),
    "slicing": (strategies.slicing, SINGLE),
    "users_partitioner": (lambda p, q: strategies.advanced_extended(p, q, chains.Bands()), SINGLE),
}


@pytest.mark.parametrize("name", DETECTED)
def test_points_of_a_value_and_pane_are_joined_once(spark, monkeypatch, name):
    joined, (strategy, q) = Joined(monkeypatch), DETECTED[name]
    assert counted(strategy(sources.from_list(spark, crowd()), q)) == brute(crowd(), q)
    assert joined.few()


@pytest.mark.parametrize("name", [n for n in DETECTED if n in ("rk_psod", "rk_sop", "naive", "advanced", "slicing")])
def test_ids_that_come_twice_are_told_apart(spark, name):
    """An id's points are no neighbours of each other; they count as one point with the neighbours of both."""
    points, (strategy, q) = crowd(2), DETECTED[name]
    twice = points + [(points[0][0], points[0][1], points[0][2])]
    once = counted(strategy(sources.from_list(spark, points), q))
    found = counted(strategy(sources.from_list(spark, twice), q))
    assert found.keys() == once.keys() and all(found[key] <= once[key] for key in found)


def test_users_detector_joins_points_of_a_value_and_pane_once(spark, monkeypatch):
    joined, points = Joined(monkeypatch), crowd()
    found = chains.Cheap()(sources.from_list(spark, points), RKWS)
    assert counted(found) == brute([p for p in points if p[1][0] < 50], RKWS) and joined.few()


def test_a_fitted_tree_joins_points_of_a_value_and_pane_once(spark, monkeypatch, tmp_path):
    joined, points, file = Joined(monkeypatch), sources.from_list(spark, crowd()), f"{tmp_path}/sample"
    points.selectExpr("cast(value[0] as string)").write.text(file)
    config = chains._config("advanced_extended", SINGLE).tree_partitioned(file, 100, 4).build()
    found = Pipeline.create(spark, config).read_from(points).partition().detect_outliers().aggregate()
    assert counted(found) == brute(crowd(), SINGLE) and joined.few()


def test_text_sink_joins_points_of_a_value_and_pane_once(spark, monkeypatch, tmp_path):
    joined, path = Joined(monkeypatch), f"{tmp_path}/text"
    Pipeline.create(spark, chains._config("slicing", SINGLE).build()).read_from(sources.from_list(spark, crowd())).run(TextSink(path))
    assert spark.read.text(path).count() == len(brute(crowd(), SINGLE)) and joined.few()


def all_pairs(points, q):
    """(id, pane, other, other pane, layer) of neighbours that some window may hold."""
    out = []
    for i, v, t in points:
        for j, u, s in points:
            d = math.dist(v, u)
            if i != j and d <= q.max_range and abs(t // q.pane - s // q.pane) < q.max_window // q.pane:
                out.append((i, t // q.pane, j, s // q.pane, sum(d > r for r in q.ranges)))
    return out


def test_pane_counts_join_points_of_a_value_and_pane_once(spark, monkeypatch):
    joined, want = Joined(monkeypatch), {}
    for i, pane, _, other, layer in all_pairs(crowd(), RK):
        want[i, pane, other, layer] = want.get((i, pane, other, layer), 0) + 1
    rows = counting.neighbour_counts(sources.from_list(spark, crowd()), RK).collect()
    assert len(rows) == len(want) and {(r.id, r.pane, r.other_pane, r.layer): r.n for r in rows} == want and joined.few()


def test_layer_counts_join_points_of_a_value_and_pane_once(spark, monkeypatch):
    joined, layers = Joined(monkeypatch), [p[4] for p in all_pairs(crowd(), RK)]
    rows = counting.layer_counts(sources.from_list(spark, crowd()), RK).collect()
    assert {r.layer: r.n for r in rows} == {i: layers.count(i) for i in set(layers)} and joined.few()


def test_outlier_points_join_points_of_a_value_and_pane_once(spark, monkeypatch):
    joined, points, want = Joined(monkeypatch), crowd(), {}
    for e in sorted({e for _, _, t in points for e in range((t // 10 + 1) * 10, t + 21, 10)}):
        live = [p for p in points if e - 20 <= p[2] < e]
        n = {i: sum(j != i and abs(v[0] - u[0]) <= 1.0 for j, u, _ in live) for i, v, _ in live}
        want.update({(e, i): c for i, c in n.items() if c < 9})
    rows = counting.outlier_points(sources.from_list(spark, points), SINGLE).collect()
    assert len(rows) == len(want) and {(r.window_end, r.id): r.neighbours for r in rows} == want and joined.few()


def test_skyband_joins_points_of_a_value_and_pane_once(spark, monkeypatch):
    points = sources.from_list(spark, crowd())
    want = strategies.k_skyband(counting.pairs(counting.with_panes(points, RK), RK), RK).select("id", "other", "layer").collect()
    joined = Joined(monkeypatch)
    found = strategies.skyband(points, RK).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and joined.few()


def test_range_limit_does_not_make_all_pairs_within_the_range(spark, monkeypatch):
    def never(*a, **k):
        raise AssertionError("all pairs")

    monkeypatch.setattr(neighbours, "range_neighbours", never)
    points, want = crowd(), []
    for i, v, _ in points:
        near = sorted((abs(v[0] - u[0]), j) for j, u, _ in points if j != i and abs(v[0] - u[0]) <= 1.0)
        want += [(i, rank, j, d) for rank, (d, j) in enumerate(near[:3], 1) if i % 3 == 0]
    table = sources.from_list(spark, points)
    assert sorted(map(tuple, neighbours.range_limit(table, 1.0, 3, table.where("id % 3 = 0")).collect())) == sorted(want)


def test_all_pairs_within_a_range_are_dealt_to_all_cores(spark, monkeypatch):
    """A few rows in few bytes make many pairs: Spark alone would join them in one task."""
    monkeypatch.setattr(neighbours, "QUERIES", 10)
    points = [(i, [float(i % 50)], i) for i in range(400)]
    table = sources.from_list(spark, points)
    found = neighbours.range_neighbours(table, 1.0, table.where("id % 2 = 0"))
    want = sorted((i, j, abs(v[0] - u[0])) for i, v, _ in points for j, u, _ in points if i % 2 == 0 and i != j and abs(v[0] - u[0]) <= 1.0)
    assert sorted(map(tuple, found.collect())) == want
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 2])
def test_latest_predecessors_do_not_make_all_pairs(spark, monkeypatch, width):
    def never(*a, **k):
        raise AssertionError("all pairs")

    monkeypatch.setattr(counting, "pairs", never)
    points, want = [(i, v * width, t) for i, v, t in crowd()], []
    for i, v, t in points:
        older = sorted(((s, j) for j, u, s in points if math.dist(v, u) <= 1.0 and (s, j) < (t, i) and t // 10 - s // 10 < 2), reverse=True)
        want += [(i, rank, j, s) for rank, (s, j) in enumerate(older[:4], 1)]
    found = evidence.latest_predecessors(sources.from_list(spark, points), SINGLE, 4)
    assert sorted(map(tuple, found.collect())) == sorted(want)


KEPT = {
    "psod": (Algorithm.PSOD, RKWS),
    "advanced_extended": (Algorithm.ADVANCED_EXTENDED, SINGLE),
    "advanced": (Algorithm.ADVANCED, SINGLE),
    "pmcsky": (Algorithm.PMCSKY, RKWS),
    "sop": (Algorithm.SOP, RKWS),
}


@pytest.mark.parametrize("name", KEPT)
def test_evidence_of_a_stream_is_kept_by_pane_and_not_by_pair(monkeypatch, name):
    algorithm, q = KEPT[name]
    most, trim, n = [0], E.Layers._trim, 3_000
    monkeypatch.setattr(E.Layers, "_trim", lambda self: (most.append(len(self.who)), trim(self))[1])
    value = np.append(np.random.default_rng(1).integers(0, 40, n - 1) * 0.25, 500.0)[:, None]
    points = {"ids": np.arange(n), "arrival": np.arange(n) * 10 // n, "flag": np.zeros(n, dtype=np.int8), "value": value}
    found = E.detector(algorithm, q)
    counts = found.slide(10, points, True)
    assert counts[: len(q.ks)] == [1] * len(q.ks)
    assert max(most) <= n * len(q.ranges)
    assert found.compared <= n * n


def test_spark_windows_count_crowds_without_all_distances():
    n, rng = 60_000, np.random.default_rng(1)
    quarters = np.append(rng.integers(0, 4_000, n - 500), 8_000 + 4 * np.arange(500))
    began = time.perf_counter()
    counts = counts_of(np.arange(n), np.arange(n) * 20 // n, np.zeros(n, dtype=np.int8), quarters[:, None] * 0.25, 20, SINGLE)
    number = np.bincount(quarters, minlength=10_010)
    near = np.convolve(number, np.ones(9, dtype=int), "same")[quarters] - 1
    assert counts == [int((near < 9).sum())] and time.perf_counter() - began < 5
