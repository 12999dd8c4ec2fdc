"""The pipeline against brute force, stage by stage."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panewise.llm import pieces, simhash
from tests.llm.test_documents import brute_classes, documents, quality_of


def test_each_stage_on_what_the_last_one_kept(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(n))
    texts = [text(rng.randint(22, 90)) for _ in range(25)]
    texts += [texts[0], texts[1] + " more", texts[2], "too short", None, "again and " * 40, text(30) + " mail ann@site.org or +1 (743) 555-3824", ""]
    rows = [(i, t, "big" if i % 3 else "small") for i, t in enumerate(texts)]
    docs, kept = documents(spark, rows), {i: t for i, t, _ in rows}
    columns = docs.columns

    kept = {i: t for i, t in kept.items() if not quality_of(t)[-1]}
    docs = corpus_pipeline.quality_rules(spark, docs, "")
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == kept

    ids = sorted(kept)
    root = brute_classes([simhash.fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for n, i in enumerate(ids) if root[n] == n}
    assert 25 not in kept and 27 not in kept
    docs = corpus_pipeline.near_dedup(spark, docs, "")
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == kept

    kept = {i: t.replace("ann@site.org", "[EMAIL]").replace("+1 (743) 555-3824", "[PHONE]") for i, t in kept.items()}
    docs = corpus_pipeline.private_data(spark, docs, "")
    assert docs.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in kept.items()}

    docs = corpus_pipeline.mixture(spark, docs, "")
    uses = [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == columns and set(uses) == set(kept.items()) and all(uses.count(u) <= 2 for u in set(uses))

    library = pieces.load(pieces.default_path()).library
    found = [(r.doc_id, list(r.ids), r.n_tokens) for r in corpus_pipeline.piece_ids(spark, docs, "").collect()]
    assert sorted(found) == sorted((i, ids := library.encode(t), len(ids)) for i, t in uses)


def test_the_whole_run_and_its_stages(spark, tmp_path):
    documents(spark, [(i, f"number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "s") for i in range(4)]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "private_data", "mixture", "piece_ids"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    documents(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("own", "most"), [("64m", corpus_pipeline.BATCH), ("67108864b", corpus_pipeline.BATCH), ("1m", 1 << 20)])
def test_a_batch_of_texts_is_not_a_whole_task(spark, own, most):
    def sizes(given):
        for batch in given:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefghij"), 500).alias("text"))
    before = spark.conf.get(corpus_pipeline.LIMIT)
    spark.conf.set(corpus_pipeline.LIMIT, own)
    try:
        corpus_pipeline.piece_ids(spark, docs, "")
        found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    finally:
        spark.conf.set(corpus_pipeline.LIMIT, before)
    assert sum(r.n for r in found) == 3000 and max(r.bytes for r in found) < 1.1 * most
