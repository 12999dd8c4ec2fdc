"""Runs of words against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panewise.llm import periodic as P
from tests.llm.test_documents import clashing, documents


def brute(words, least, times):
    """Every distance compared word by word; of equal stretches the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                out.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 4), st.integers(2, 9))
def test_main_lorentz_finds_all_runs(ids, times, least):
    found = sorted((s, e - s, q) for (s, e), q in P.main_lorentz(np.array(ids, dtype=np.int64), least, times).items())
    assert found == brute(ids, least, times)


def text_of(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 30))]
        words += block * rng.choice([1, 1, 2, 3, 4, 25]) + block[: rng.randint(0, len(block))]
    return words


def test_runs_of_composed_texts():
    rng = random.Random(13)
    for _ in range(400):
        words = text_of(rng)
        runs = P.runs_of(words)
        assert runs == sorted(brute(words, P.LEAST, P.TIMES), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert P.kept_words(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def test_z_function():
    rng = random.Random(2)
    for _ in range(100):
        s = [rng.randint(0, 1) for _ in range(rng.randint(1, 40))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert P.z_function(np.array(s)).tolist() == want
    assert len(P.z_function(np.zeros(0, dtype=np.int64))) == 0


def test_long_texts_take_near_linear_time():
    one = P.runs_of([b"a"] * 60_000)
    assert one == [(0, 60_000, 1)]
    words = [i % 997 for i in range(60_000)]
    assert P.runs_of(words) == [(0, 60_000, 997)]


def test_rows_and_planted_repeats(spark):
    rng = random.Random(7)
    texts = {i: " ".join(text_of(rng)) for i in range(120)}
    rows = [(i, t, "s") for i, t in texts.items()] + [(None, "a b " * 40, "s"), (7, "twice \t\n the same id", "s"), (900, None, "s"), (901, " \n ", "s"), (902, "é   x y " * 30, "s")]
    found = P.digest(P.periodic(P.planted(clashing(documents(spark, rows))))).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id != 7}
    for i, text in [*texts.items(), (900, ""), (901, ""), (902, rows[-1][1])]:
        if i == 7:
            continue
        words, h = [w.decode() for w in text.encode().split()], zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        runs = sorted(brute(words, 24, 3), key=lambda r: (r[0], r[2]))
        r = by_id[i]
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert by_id[None].n_runs == 1
    assert P.digest(P.periodic(P.planted(documents(spark, [])))).count() == 0
