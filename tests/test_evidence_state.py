"""Strategies of streams, for one key, against brute force; what they compare."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panewise.config import Algorithm, QuerySet, Space
from panewise.streaming import evidence as E
from tests.test_engine import brute

SETS = {
    Space.SINGLE: QuerySet.of(3, 1.0, 20, 5),
    Space.RK: QuerySet.of([1, 3, 6], [0.4, 1.0, 2.5], 24, 6),
    Space.RKWS: QuerySet.of([2, 5], [0.5, 1.5], [10, 15, 30], [5, 10]),
}


def columns(points):
    value = np.array([list(v) for _, v, _ in points], dtype=float)
    return {"ids": np.array([i for i, _, _ in points]), "arrival": np.array([t for _, _, t in points]), "flag": np.zeros(len(points), dtype=np.int8), "value": value}


def played(found, points, q, reload=False):
    """Counts of all windows, slide by slide; reload: the state goes through bytes after each."""
    out, algorithm = {}, found
    found = E.detector(algorithm, q)
    step, last = q.slide, max(t for _, _, t in points)
    for end in range((min(t for _, _, t in points) // step + 1) * step, last + q.max_window + 1, step):
        new = [p for p in points if end - step <= p[2] < end]
        due = any(end % s == 0 for s in q.slides)
        counts = found.slide(end, columns(new) if new else None, due)
        assert (counts is None) == (not due)
        for n, (w, r, k) in zip(counts or (), ((w, r, k) for w in q.windows for r in q.ranges for k in q.ks)):
            out.update({(end, r, k, w, s): n for s in q.slides if end % s == 0 and n is not None})
        if reload:
            panes = [E.unpack(E.pack(found.points(p))) for p in np.unique(found.pane).tolist()]
            kept, compared = E.unpack(E.pack(found.evidence())), found.compared
            found = E.detector(algorithm, q)
            found.load(panes, kept)
            found.compared = compared
    return out, found.compared


def clustered(n, width, seed, span):
    """Points around few centres that move, and others anywhere; some values and times repeat."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.randint(0, span)
        base = [rng.choice([0.0, 3.0, 7.0]) + t / 40] * width if rng.random() < 0.7 else [rng.uniform(-4, 12)] * width
        out.append((i, [round(b + rng.gauss(0, 0.3), 2) for b in base], t))
    return out + [(n + 1, out[0][1], out[0][2]), (n + 2, out[0][1], span + 60)]


@pytest.mark.parametrize("algorithm", [a for a in Algorithm if a is not Algorithm.USER_DEFINED])
@pytest.mark.parametrize("reload", [False, True])
def test_every_strategy_counts_like_brute_force(algorithm, reload):
    for seed, (n, width, span) in enumerate([(160, 1, 70), (120, 2, 40), (60, 3, 90), (1, 1, 5)]):
        points = clustered(n, width, seed, span)
        for space in algorithm.spaces:
            q = SETS[space]
            assert played(algorithm, points, q, reload)[0] == brute(points, q), (algorithm, seed, space)


def test_windows_that_are_no_multiple_of_the_slide():
    q = QuerySet.of(2, 1.0, 14, 4)
    points = clustered(90, 1, 8, 50)
    for algorithm in (Algorithm.SLICING, Algorithm.PMCOD, Algorithm.PMCOD_NET):
        assert played(algorithm, points, q)[0] == brute(points, q)


def crowd(span):
    rng = random.Random(3)
    return [(i, [rng.uniform(0, 20)], t) for i, t in enumerate(t for t in range(span) for _ in range(12))]


@pytest.mark.parametrize("algorithm", [Algorithm.SLICING, Algorithm.PMCOD, Algorithm.SOP])
def test_compared_pairs_do_not_grow_with_the_window(algorithm):
    """With windows of 5 and 20 slides: dense points stop at k, or join clusters, whatever the window holds."""
    spans = 120
    space = QuerySet.of(4, 1.0, 25, 5), QuerySet.of(4, 1.0, 100, 5)
    small, large = (played(algorithm, crowd(spans), q)[1] for q in space)
    again = played(Algorithm.NAIVE, crowd(spans), space[1])[1]
    assert large < 1.3 * small and large < again / 20
