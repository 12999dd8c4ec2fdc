"""Pivots and the two rounds of nearest neighbours, against all pairs; how many pairs are compared."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panewise.config import QuerySet
from panewise.operators import neighbours
from panewise.operators.pivots import Pivots
from panewise.plans import counting, strategies
from panewise.sources import points as sources
from tests.test_engine import brute, counted


def vectors(n, width, seed, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width)) * 3
    value = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * 0.15
    return [(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(value, rng.integers(0, 100, n)))]


def test_outliers_of_many_components(spark):
    points = vectors(150, 16, 1) + [(900, [0.0] * 16, 5), (901, [0.0] * 16, 6)]
    q = QuerySet.of([2, 8], [0.5, 0.9], 40, 10)
    for strategy in (strategies.slicing, strategies.pmcod, strategies.advanced):
        assert counted(strategy(sources.from_list(spark, points), q)) == brute(points, q)


def test_compared_pairs_are_few_on_clustered_vectors(spark):
    points, q = vectors(1500, 32, 2, 40), QuerySet.of(3, 1.2, 1000, 1000)
    panes = counting.with_panes(sources.from_list(spark, points), q)
    compared, found = counting.candidates(panes, q).count(), counting.pairs(panes, q).count()
    print(f"{compared} pairs compared, {found} within the range, {len(points) * (len(points) - 1)} in all")
    assert found <= compared < 0.15 * len(points) * (len(points) - 1)


def test_pivots_rule_no_neighbour_out(spark):
    for seed, scale in ((3, 1e-6), (4, 1.0), (5, 1e9)):
        points = [(i, [scale * x for x in v], t) for i, v, t in vectors(120, 20, seed, 3)]
        table, r = sources.from_list(spark, points), 0.8 * scale
        x = np.array([v for _, v, _ in points])
        d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
        want = {(i, j) for i, j in zip(*np.nonzero(d <= r * (1 - 1e-12))) if i != j}
        assert want <= {(a, b) for a, b, _ in neighbours.range_neighbours(table, r).collect()}
    assert Pivots.choose(sources.from_list(spark, []), 1.0).values == ()


@pytest.mark.parametrize("width", [1, 2, 6])
def test_nearest_in_two_rounds(spark, monkeypatch, width):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    rng = random.Random(width)
    points = [(i, [round(rng.gauss(0, 1), 2 if i % 3 else 0) for _ in range(width)], i) for i in range(240)]
    points += [(1000 + i, [0.5] * width, 0) for i in range(30)] + [(2000, [50.0] * width, 0)]
    table, n = sources.from_list(spark, points), 4
    x, ids = np.array([p[1] for p in points]), [p[0] for p in points]
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    want = {ids[i]: sorted((d[i, j], ids[j]) for j in range(len(ids)) if j != i)[:n] for i in range(len(ids))}
    for queries in (None, table.where("id % 7 = 0")):
        found = {}
        for r in neighbours.nearest(table, n, queries).orderBy("id", "rank").collect():
            found.setdefault(r.id, []).append((r.distance, r.other))
        asked = ids if queries is None else [i for i in ids if i % 7 == 0]
        assert sorted(found) == sorted(asked)
        for i in asked:
            assert [o for _, o in found[i]] == [o for _, o in want[i]] and np.allclose([a for a, _ in found[i]], [a for a, _ in want[i]])


def test_nearest_of_few_points(spark):
    table = sources.from_list(spark, [(1, [0.0], 0), (2, [3.0], 0), (3, [0.0], 0)])
    found = sorted((r.id, r["rank"], r.other) for r in neighbours.nearest(table, 5).collect())
    assert found == [(1, 1, 3), (1, 2, 2), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert neighbours.nearest(table.limit(0), 2).count() == 0 and neighbours.nearest(table.where(F.col("id") == 1), 2).count() == 0
