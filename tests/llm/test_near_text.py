"""Near-duplicate texts against brute force on whole sets of shingles."""

from __future__ import annotations

import random

import corpus_pipeline
from panewise.llm import near_text, simhash
from tests.llm.test_documents import clashing, documents, planned


def similarity(a, b):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def brute_kept(texts):
    """The smallest of each class; texts link by similarity or by at most four differing bits of their fingerprints."""
    root, prints = list(range(len(texts))), [simhash.fingerprint(t, near_text.WORDS) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= near_text.LIMIT:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return [i for i, r in enumerate(root) if r == i]


def test_the_stage_leaves_one_of_each_group_of_near_copies(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(words))
        for _ in range(6):
            copy = list(words)
            for place in rng.sample(range(len(copy)), rng.randint(1, 3)):
                copy[place] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    texts += ["two words", "Two  WORDS", "three other words"]
    want = brute_kept(texts)
    assert 12 < len(want) < len(texts) - 30
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = corpus_pipeline.near_dedup(spark, docs, "")
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == want


def test_rows_of_a_repeated_id_get_their_own_verdicts(spark):
    text = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    rows = [(5, text, "s"), (5, text + " more", "s"), (5, text, "s"), (5, other, "s"), (2, other + " more", "s"), (None, text, "s"), (7, None, "s"), (8, "", "s")]
    docs = clashing(documents(spark, rows))
    assert near_text.keep_one(docs).columns == docs.columns
    kept = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in near_text.keep_one(docs).collect())
    assert kept == [(0, "a"), (2, "b"), (5, "a"), (7, "")]
    assert near_text.keep_one(documents(spark, [])).count() == 0


def test_a_chain_and_the_bound(spark):
    """Only neighbours on the chain are similar enough; exactly 0.8 links, less does not."""
    words = [f"c{i}" for i in range(100)]
    chain = [" ".join(words[k : k + 54]) for k in range(0, 25, 5)]
    assert similarity(chain[0], chain[1]) > 0.8 > similarity(chain[0], chain[2])
    one, two, three = ([f"d{i}" for i in range(n)] for n in (12, 14, 15))
    assert similarity(" ".join(one), " ".join(two)) == 0.8 > similarity(" ".join(one), " ".join(three))
    texts = [*chain, " ".join(one), " ".join(two), "e " + " ".join(three[::-1]), " ".join(one[::-1])]
    kept = [r.doc_id for r in near_text.keep_one(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()]
    assert sorted(kept) == brute_kept(texts)


def test_the_exact_mode_loses_no_link(spark, monkeypatch):
    """Texts of a few sentences each, in many mixtures: classes equal those of all pairs, also where no MinHash key is shared."""
    rng = random.Random(8)
    sentences = [[f"s{k}w{rng.randrange(400)}" for _ in range(14)] for k in range(40)]
    texts = []
    for _ in range(30):
        base = rng.sample(range(40), 8)
        for _ in range(5):
            picked = [k for k in base if rng.random() < 0.95]
            words = [w for k in picked for w in sentences[k]]
            for place in rng.sample(range(len(words)), rng.randint(0, 3)):
                words[place] = rng.choice(["x", "y", f"z{rng.randrange(10**6)}"])
            texts.append(" ".join(words))
    texts += ["the common line of all texts " * 2 + f"n{i} m{i}" for i in range(40)] + ["", "one two"]
    want = brute_kept(texts)
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert 40 < len(want) < len(texts) - 40
    monkeypatch.setattr(near_text, "band_keys", lambda found: [])  # the exact mode finds them alone
    assert sorted(r.doc_id for r in near_text.keep_one(docs, exact=True).collect()) == want


def test_no_join_is_left_to_an_estimate_of_size(spark, monkeypatch):
    """Spark takes what explode() multiplies for small, and broadcast it from the driver: only counted tables may be."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(12)]
    texts = [t + more for t in texts for more in ("", "", " x", " y z")]
    plans = planned(monkeypatch, near_text, simhash)
    kept = near_text.keep_one(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), broadcast_rows=-1)  # no table is small
    plans.append(("kept", kept._jdf.queryExecution().sparkPlan().toString()))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(texts)
    assert {"written near-sets", "connected near-stars", "written first-marked"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan] == []
