"""SimHash near-duplicates widened to texts whose sets of five-word shingles have a Jaccard similarity of 0.8.

Texts are equal here if their sets of shingles are; the distinct sets are the nodes. Nodes link if

* their SimHash fingerprints of five words differ in at most LIMIT bits: all such pairs, by `simhash.link_roots`; or
* their similarity is at least NUMERATOR / DENOMINATOR, compared on the whole sets, and one is the centre of a key that both have.

At a similarity of 0.8 fingerprints differ in 9 to 10 bits and often in 14. So wide a limit leaves the pigeonring filter's chains
nothing to prune: its candidates are a fixed share of all pairs. The keys are therefore BANDS times ROWS minima (MinHash): two
sets of similarity x share none with probability (1 - x ** ROWS) ** BANDS, at 0.8 about 7 in 100,000.

Centres. The text that others were copied from shares more keys with the copies than they share with each other. Of a key's
nodes the centre is that with the most companions over all its keys, and all are held against it: as many comparisons as the
key has nodes, and not their square. A second round takes a further centre among the nodes that are not in the first one's
class. Pairs of nodes neither of which is a centre, and that are no SimHash pair, only meet through others; with exact=True
they, and pairs without a common key, are found by a prefix filter on rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm import simhash
from panewise.llm._common import connected, few_or_shuffled, shuffled, written

WORDS, SEED, LIMIT = 5, 42, 4
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 24, 5
#: Shingles whose minima are taken at once, and rows of an Arrow batch that is returned: bounds of a task's memory.
BLOCK, SLICE = 1024, 500

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(simhash.hashes(text, WORDS, SEED))


def band_keys(found: np.ndarray) -> list[int]:
    """The keys of a set of shingles, as signed longs; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[k : k + BLOCK] * _FACTORS + _OFFSETS).min(axis=1))
    data, width = least.tobytes(), ROWS * 8
    keys = np.array([xxhash.xxh64_intdigest(data[b * width : (b + 1) * width], b) for b in range(BANDS)], dtype=np.uint64)
    return keys.view(np.int64).tolist()


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text): a row is known by its id and its text's hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash.digest().alias("digest"), F.col("text").cast("string").alias("text"))


def _prints(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, node, size, fp, keys) of each row: node is a hash of its set of shingles, fp its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)):
                fps, sizes, keys, nodes = [], [], [], []
                for x in batch.column(2):
                    found = simhash.hashes(x.as_py(), WORDS, SEED)
                    fps.append(simhash.majority(found))
                    found = np.unique(found)
                    sizes.append(len(found))
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    keys.append(band_keys(found))
                longs = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
                columns = [batch.column(0), batch.column(1), longs(nodes), pa.array(sizes, pa.int64()), longs(fps), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "node", "size", "fp", "keys"])

    return rows.mapInArrow(run, "doc_id long, digest long, node long, size long, fp long, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, found) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)):
                found = pa.array([shingles(x.as_py()).view(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["node", "found"])

    return texts.mapInArrow(run, "node long, found array<long>")


def _may_reach(a: str, b: str) -> Column:
    """Sets of these sizes can be similar enough: the smaller one in the larger one."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def _confirmed(pairs: DataFrame, sets: DataFrame, broadcast_rows: int) -> DataFrame:
    """The pairs (u, v) of at least the similarity, compared on their whole sets."""
    first = sets.select(F.col("node").alias("u"), F.col("found").alias("a")).join(few_or_shuffled(pairs, broadcast_rows), "u")
    both = first.join(shuffled(sets.select(F.col("node").alias("v"), F.col("found").alias("b"))), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common * DENOMINATOR >= (F.size("a") + F.size("b") - common) * NUMERATOR).select("u", "v")


def link_roots(members: DataFrame, sets: DataFrame, broadcast_rows: int) -> DataFrame:
    """(node, root) of the nodes in members (key, node, size, weight), the rows of keys that two nodes or more share."""

    def merged(roots: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """roots after the classes that confirmed pairs (u, v, ru, rv: roots) join have become one."""
        pairs = written(pairs.distinct(), f"{name}-pairs")
        edges = _confirmed(pairs.select("u", "v"), sets, broadcast_rows).join(shuffled(pairs), ["u", "v"]).select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        return written(_lowered(roots, edges, name, broadcast_rows), f"{name}-roots")

    def stars(rows: DataFrame, centres: DataFrame) -> DataFrame:
        found = rows.join(shuffled(centres), "key").where(F.col("root") != F.col("c.root")).where(_may_reach("size", "c.size"))
        return found.select(F.col("node").alias("u"), F.col("c.node").alias("v"), F.col("root").alias("ru"), F.col("c.root").alias("rv"))

    def centres(rows: DataFrame, name: str) -> DataFrame:
        """(key, c): each key's centre, as a table. A join with a table is split where a key is hot, one with an aggregate is not."""
        return written(rows.groupBy("key").agg(F.max(F.struct("weight", "node", "size", "root")).alias("c")), name)

    rows = members.withColumn("root", F.col("node"))
    roots = merged(rows.select("node", "root").distinct(), stars(rows, centres(rows, "near-first")), "near-stars")
    rows = written(members.join(shuffled(roots), "node"), "near-rows")
    first = centres(rows, "near-taken").select("key", F.col("c.root").alias("taken"))
    others = written(rows.join(shuffled(first), "key").where(F.col("root") != F.col("taken")).drop("taken"), "near-untaken")
    return merged(roots, stars(rows, centres(others, "near-second")), "near-others")


def prefix_roots(roots: DataFrame, sets: DataFrame, broadcast_rows: int) -> DataFrame:
    """roots (node, root) after all links between different classes: none is lost.

    A set's shingles are ordered by how many sets have them, the rarest first. Two sets of n shingles and of the similarity share one
    of the first n - ceil(0.8 n) + 1 of both (the prefix filter), so that all pairs to be compared meet in these. A shingle that
    one set alone has is no key, but takes a place of the prefix: a set that is new in over a fifth has no key at all. Of a
    key's members first the most common class's one centre is compared, then those of different classes and of fitting sizes.
    """
    grams = sets.select("node", F.size("found").alias("size"), F.explode("found").alias("key"))
    common = grams.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "key")
    ranked = grams.join(shuffled(common), "key", "left").withColumn("place", F.row_number().over(order))
    first = F.col("size") - F.ceil(F.col("size") * NUMERATOR / DENOMINATOR) + 1
    keys = written(ranked.where((F.col("place") <= first) & F.col("n").isNotNull()).select("key", "node", "size"), "prefix-keys")
    for step in ("stars", "pairs"):
        rows = written(keys.join(shuffled(roots), "node"), f"prefix-{step}-rows")
        if step == "stars":
            other = rows.groupBy("key").agg(F.max(F.struct("size", "node", "root")).alias("c")).select("key", F.col("c.node").alias("v"), F.col("c.size").alias("size2"), F.col("c.root").alias("rv"))
        else:
            other = rows.select("key", F.col("node").alias("v"), F.col("size").alias("size2"), F.col("root").alias("rv"))
        pairs = rows.select("key", F.col("node").alias("u"), "size", F.col("root").alias("ru")).join(shuffled(other), "key").where(F.col("ru") != F.col("rv")).where(_may_reach("size", "size2"))
        pairs = pairs if step == "stars" else pairs.where(F.col("u") < F.col("v"))
        pairs = written(pairs.select("u", "v", "ru", "rv").distinct(), f"prefix-{step}")
        edges = _confirmed(pairs.select("u", "v"), sets, broadcast_rows).join(shuffled(pairs), ["u", "v"]).select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        roots = written(_lowered(roots, edges, f"prefix-{step}", broadcast_rows), f"prefix-{step}-roots")
    return roots


def _lowered(roots: DataFrame, edges: DataFrame, name: str, broadcast_rows: int) -> DataFrame:
    """roots (node, root) after the roots that edges (u, v) join have become one."""
    joined = connected(edges, name).where("node <> root").select(F.col("node").alias("was"), F.col("root").alias("lower"))
    joined = few_or_shuffled(written(joined, f"{name}-joined"), broadcast_rows)
    return roots.join(joined, F.col("root") == F.col("was"), "left").select("node", F.coalesce("lower", "root").alias("root"))


def classes(docs: DataFrame, broadcast_rows: int = 200_000, exact: bool = False) -> DataFrame:
    """(doc_id, digest, root) of each row of docs (doc_id, text); rows of equal root are one class.

    exact: with prefix_roots() over all sets, so that no link is lost; it shuffles every shingle of every different set.
    """
    rows = _rows(docs)
    prints = written(_prints(rows), "near-prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "digest", "size", "fp", "keys")).alias("p"))
    nodes = written(nodes.select("node", "p.*"), "near-nodes")
    members = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-keys")  # as a table: see centres()
    members = written(members.join(shuffled(shared), "key"), "near-shared")
    weights = written(members.groupBy("node").agg(F.sum("n").alias("weight")), "near-weights")
    members = written(members.join(shuffled(weights), "node").select("key", "node", "size", "weight"), "near-members")
    asked = (nodes.where("size > 0") if exact else nodes.join(shuffled(weights), "node", "left_semi")).select("node", "doc_id", "digest")
    asked = few_or_shuffled(written(asked, "near-asked"), broadcast_rows).alias("x")
    texts = rows.alias("t").join(asked, F.col("t.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("t.digest") == F.col("x.digest")))
    sets = written(_sets(texts.select("x.node", "t.text")).dropDuplicates(["node"]), "near-sets")
    roots = link_roots(members, sets, broadcast_rows)
    if exact:
        every = nodes.where("size > 0").select("node").join(shuffled(roots), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        roots = prefix_roots(written(every, "near-every"), sets, broadcast_rows)

    # SimHash classes on top: a class's roots become one.
    alike = simhash.link_roots(nodes.select("fp").distinct(), LIMIT, broadcast_rows=broadcast_rows)
    every = nodes.select("node", "fp").join(shuffled(roots), "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root"))
    every = written(every.join(shuffled(alike.select("fp", F.col("root").alias("alike"))), "fp").select("node", "root", "alike"), "near-alike")
    least = every.groupBy("alike").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("alike", "least")
    edges = every.join(few_or_shuffled(written(least, "near-least"), broadcast_rows), "alike").where("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v"))
    found = _lowered(every.select("node", "root"), edges, "near-simhash", broadcast_rows).where("node <> root")
    found = few_or_shuffled(written(found, "near-classes"), broadcast_rows)
    return prints.select("doc_id", "digest", "node").join(found, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, broadcast_rows: int = 200_000, exact: bool = False) -> DataFrame:
    """The documents with one row of each class left, one of the smallest doc_id, as it was; see simhash.keep_first().

    A null or empty text, or one without words, has no shingles; such texts are one class.
    """
    return simhash.keep_first(docs, classes(docs, broadcast_rows, exact), broadcast_rows)
