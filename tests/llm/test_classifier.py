"""The quality classifier: splits and traversal against plain versions, accuracy on documents that lent no label, awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from panewise.llm import classifier as K
from tests.llm.test_documents import clashing, documents
from tests.oracle import DATA


def test_best_split_equals_trying_all():
    rng = np.random.default_rng(1)
    s = K.Settings(bins=6, least=1.0)
    codes, node, g, h = rng.integers(0, 6, (200, 3)), rng.integers(0, 2, 200), rng.normal(size=200), rng.uniform(0.1, 0.3, 200)
    which, upto, gain = K.best_splits(codes, node, 2, g, h, 6, s)
    for k in (0, 1):
        best = 0.0
        mine = node == k
        for f in range(3):
            for b in range(6):
                left, right = mine & (codes[:, f] <= b), mine & (codes[:, f] > b)
                if h[left].sum() >= 1 and h[right].sum() >= 1:
                    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.shrink)
                    best = max(best, part(left) + part(right) - part(mine))
        assert gain[k] == pytest.approx(best)


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    s = K.Settings(trees=15, depth=3)
    forest = K.fit(x, y, s)

    def walk(row):
        total = forest.base
        for t in range(15):
            at = 0
            while at < 7:
                at = 2 * at + 1 + bool(row[forest.statistic[t, at]] > forest.bound[t, at])
            total += forest.value[t, at - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.skipif(not DATA.exists(), reason="no generated tables")
def test_accuracy_on_held_out_documents(spark):
    data = DATA.parent / "sf0.01"
    found = K.classify(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    rows = found.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    out = rows[rows.held_out]
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    order = (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean()
    assert (out.predicted == out.quality).mean() > 0.9 and order > 0.85
    assert (out[out.quality == 1].predicted == 1).mean() > 0.95


def test_no_label_of_a_held_out_document_is_read(spark):
    texts = [(i, ("fine words in a row " if i % 2 else "|| ## || $$ ") * 8, "s") for i in range(120)]
    docs = documents(spark, texts)
    true = [(i, i % 2) for i in range(120)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in true]
    one, two = (sorted(map(tuple, K.classify(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect())) for rows in (true, turned))
    assert one == two and {r[3] for r in one if r[0] % 2} == {1} and {r[3] for r in one if not r[0] % 2} == {0}


def test_awkward_rows(spark):
    rows = [(1, None, "a"), (1, "again", "a"), (2, "", "a"), (None, "no id", None), (3, "x" * 200_000, "b"), (4, "\t\n", "b"), (5, "{}\\ ]^- = é Ünd ÄÖ!! !!", "b")]
    docs = clashing(documents(spark, rows))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    found = K.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    none = K.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert K.classify(docs.limit(0), labels).count() == 0


def test_the_sample_is_bounded_and_the_same_whatever_the_order(spark):
    docs = documents(spark, [(i, f"word {i} " * (i % 7 + 1), "s") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    s = K.Settings(sample=50)
    one, two = (K.training_rows(K.measured(d), labels, s=s) for d in (docs, docs.repartition(7)))
    assert len(one[0]) == 50 and (one[0] == two[0]).all() and (one[1] == two[1]).all()
