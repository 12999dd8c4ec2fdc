"""SimHash near-duplicate detection with a pigeonring filter.

A text's fingerprint has 64 bits: a bit is set if it is set in over half the XXH64 hashes of the text's word shingles. Two
fingerprints link if at most `limit` bits differ; linked documents form classes.

Pigeonring. The bits are cut into limit + 1 segments, seen as a ring. If at most `limit` bits differ in all, there is a
segment to start from such that every chain of l consecutive segments from it has at most floor(l * limit / (limit + 1))
differing bits: 0 in the first, at most 1 in the first two, and so on (the pigeonhole principle only gives the first of
these). Candidates are pairs that pass the first `depth` budgets; they meet in an equality join, because the probing side
lists the few ways in which the first segments may differ. The later budgets prune them before the whole Hamming distance.

Dense groups. Copies collapse into one fingerprint before any pairing. Thousands of different fingerprints can still lie
close together; their pairs are not all listed: a bucket's members are first held against one leader, what links becomes one
class, then every class has one head in a bucket. The last round compares every candidate pair whose ends are not yet in one
class, from the smaller class to the larger, after probes of buckets that hold no larger class than their own have gone. A
probe is held against the head of each class in the bucket. Members of the class lie within a radius of the head, and their
distances to it are known: by the triangle inequality the probe need only be compared with those whose distance to the head
is within `limit` of its own. So two large classes that share a bucket and lie apart are not compared member by member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.llm._common import connected, few_or_shuffled, shuffled, written

BITS = 64
#: Fingerprints of a task that lists the keys of probes.
PROBES = 20_000
#: Hashes whose bits are unpacked at once, so that a long text takes no more memory than this allows.
BLOCK = 1 << 16


def hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included: A-Z in lower case, words between white space; fewer words are one shingle, none give none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, hash_of = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hash_of(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist() if words > 1 else (ends - lengths).tolist()
    return np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def majority(found: np.ndarray) -> int:
    """The unsigned number whose bits are set in over half the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(found), BLOCK):
        part = found[k : k + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of a text; without words 0."""
    return majority(hashes(text, words, seed))


def digest(text_col: str = "text") -> Column:
    """By which, with its id, a row's text is known: its hash."""
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp): a row for each document, fp as a signed long. A null text counts as empty; a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "digest", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, fp long")


def segments(limit: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of limit + 1 segments that cover the 64 bits."""
    n = limit + 1
    return [(BITS * k // n, BITS * (k + 1) // n - BITS * k // n) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def chain_masks(limit: int, depth: int) -> list[tuple[int, list[int]]]:
    """For each start, as signed longs: the mask of the first `depth` segments, and the differences there that the budgets allow."""
    cut, n, out = segments(limit), limit + 1, []
    for start in range(n):
        kept, ways = 0, [(0, 0)]
        for step in range(depth):
            first, width = cut[(start + step) % n]
            kept |= ((1 << width) - 1) << first
            budget = (step + 1) * limit // n
            ways = [(way | sum(1 << first + b for b in bits), used + more) for way, used in ways for more in range(budget - used + 1) for bits in combinations(range(width), more)]
        out.append((_signed(kept), [_signed(way) for way, _ in ways]))
    return out


def chain_holds(a: Column, b: Column, limit: int, depth: int) -> Column:
    """Some start keeps all budgets: chains longer than the key's `depth` are tested one by one, the full distance last."""
    cut, n, diff, any_start = segments(limit), limit + 1, a.bitwiseXOR(b), F.lit(False)
    for start in range(n):
        kept, all_budgets = 0, F.lit(True)
        for step in range(n):
            first, width = cut[(start + step) % n]
            kept |= ((1 << width) - 1) << first
            if step + 1 >= depth:
                all_budgets = all_budgets & (F.bit_count(diff.bitwiseAND(F.lit(_signed(kept)))) <= (step + 1) * limit // n)
        any_start = any_start | all_budgets
    return any_start


def _bits(a: str, b: str) -> Column:
    """In how many bits two fingerprints differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _within(a: str, b: str, limit: int) -> Column:
    return _bits(a, b) <= limit


def _keys(nodes: DataFrame, limit: int, depth: int, probe: bool) -> DataFrame:
    """A row for each start: nodes with (start, key), or on the probing side for each allowed difference too."""
    rows = []
    for start, (kept, ways) in enumerate(chain_masks(limit, depth)):
        key = F.col("fp").bitwiseAND(F.lit(kept))
        rows += [F.struct(F.lit(start).alias("start"), key.bitwiseXOR(F.lit(way)).alias("key")) for way in (ways if probe else ways[:1])]
    return nodes.withColumn("x", F.explode(F.array(*rows))).select(*nodes.columns, "x.start", "x.key")


def link_roots(nodes: DataFrame, limit: int = 4, depth: int = 2, broadcast_rows: int = 200_000) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable through links, for the distinct fingerprints `nodes` (fp)."""
    on, parts = ["start", "key"], max(1, -(-nodes.count() // PROBES))
    probes = lambda df: _keys(df.repartition(parts, "fp"), limit, depth, probe=True)
    leader = lambda df, *by: df.groupBy(*by).agg(F.min("fp").alias("leader"))

    def merged(roots: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """roots after the classes that the edges (u, v: roots) join have become one. Few roots change, and a class may have many nodes: the changes are broadcast."""
        joined = few_or_shuffled(written(connected(edges, name).where("node <> root").withColumnRenamed("root", "lower"), f"{name}-joined"), broadcast_rows)
        out = roots.join(joined, roots.root == joined.node, "left").select("fp", F.coalesce("lower", "root").alias("root"))
        return written(out, f"{name}-roots")

    exact = _keys(nodes, limit, depth, probe=False)
    stars = exact.join(shuffled(leader(exact, *on)), on).where((F.col("fp") != F.col("leader")) & _within("fp", "leader", limit))
    roots = merged(nodes.select("fp", F.col("fp").alias("root")), stars.select(F.col("fp").alias("u"), F.col("leader").alias("v")), "simhash-stars")

    members = _keys(roots, limit, depth, probe=False)
    heads = leader(members, *on, "root").withColumnRenamed("root", "other")
    near = probes(roots).join(shuffled(heads), on).where(F.col("root") != F.col("other")).where(_within("fp", "leader", limit))
    roots = merged(roots, near.select(F.col("root").alias("u"), F.col("other").alias("v")), "simhash-heads")

    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    sizes = few_or_shuffled(written(sizes, "simhash-sizes"), broadcast_rows)
    ranked = roots.join(sizes, "root", "left").select("fp", F.struct(F.coalesce("size", F.lit(1)).alias("size"), "root").alias("rank"))
    members = _keys(ranked, limit, depth, probe=False)
    top = members.groupBy(*on).agg(F.max("rank").alias("top"))
    rest = probes(ranked).join(shuffled(top), on).where(F.col("rank") < F.col("top"))
    # A class's members in a bucket lie around its head there: a probe farther from the head than their radius and the limit meets none of them.
    several = members.where("rank.size > 1")
    measured = several.join(shuffled(leader(several, *on, "rank")), [*on, "rank"]).withColumn("d", _bits("fp", "leader"))
    balls = measured.groupBy(*on, "rank").agg(F.min("leader").alias("leader"), F.max("d").alias("radius"))
    balls = balls.unionByName(members.where("rank.size = 1").select(*on, "rank", F.col("fp").alias("leader"), F.lit(0).alias("radius")))
    met = rest.join(shuffled(balls.withColumnRenamed("rank", "rank2")), on).where(F.col("rank") < F.col("rank2")).withColumn("far", _bits("fp", "leader")).where(F.col("far") <= F.col("radius") + limit)
    met = written(met.select("fp", "rank", *on, "rank2", "leader", "radius", "far"), "simhash-met")
    ends = ["rank.root", "rank2.root", "fp", "fp2"]
    alone = met.where("radius = 0").withColumn("fp2", F.col("leader")).select(*[F.col(c).alias(n) for c, n in zip(ends, "uvab")])
    inside = measured.select(*on, F.col("rank").alias("rank2"), F.col("fp").alias("fp2"), "d")
    among = met.where("radius > 0").drop("leader").join(shuffled(inside), [*on, "rank2"]).where(F.abs(F.col("far") - F.col("d")) <= limit).select(*[F.col(c).alias(n) for c, n in zip(ends, "uvab")])
    found = alone.unionByName(among).where(chain_holds(F.col("a"), F.col("b"), limit, depth)).where(_within("a", "b", limit))
    return merged(roots, found.select("u", "v"), "simhash-rest")


def classes(prints: DataFrame, limit: int = 4, depth: int = 2, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows (doc_id, fp and others) with root, the class's smallest fingerprint, and component_id: the smallest id reachable, null if all are null.

    Every row stays, repeated ids too. `depth` is how many chain budgets the join key covers; it changes the work, not the
    result: 2 suits up to some tens of millions of distinct fingerprints, 3 more.
    """
    prints = written(prints, "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = nodes.join(shuffled(link_roots(nodes.select("fp"), limit, depth, broadcast_rows)), "fp")
    # Only classes of several fingerprints need their smallest id looked up.
    least = roots.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least")
    roots = roots.join(few_or_shuffled(written(least, "simhash-least"), broadcast_rows), "root", "left")
    ids = roots.select("fp", "root", F.coalesce("least", "first").alias("component_id"))
    return prints.join(shuffled(ids), "fp").select(*prints.columns, "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, limit: int = 4, depth: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each document, the fingerprint in 16 lower-case hex digits.

    A null or empty text has fingerprint zero and links like any other; an empty table gives no rows; columns besides
    doc_id and text are not read.
    """
    found = classes(fingerprints(docs, words, seed).drop("digest"), limit, depth)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """docs with one row of each class left, one of the smallest doc_id, as it was; found: (doc_id, digest, root) of every row.

    Rows without an id stay. Verdicts are those of rows and not of ids, so that an id may come more than once. Texts are only
    shuffled for repeated rows, or where the rows to be dropped are more than `broadcast_rows`.
    """
    known = found.where("doc_id is not null").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    known = written(known, "first-rows")
    first = known.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = few_or_shuffled(written(first.drop("rows"), "first-of-classes"), broadcast_rows)
    stays = F.coalesce(F.struct("doc_id", "digest") == F.col("first"), F.lit(True))
    marked = known.join(first, "root", "left").select("doc_id", "digest", stays.alias("stays"), "n").where("not stays or n > 1")
    marked = written(marked, "first-marked")
    some = lambda rows: few_or_shuffled(marked.where(rows).select("doc_id", "digest"), broadcast_rows)
    on = ["doc_id", "digest"]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
    kept = rows.join(some("not stays"), on, "left_anti")
    repeated = some("stays")
    again = kept.join(repeated, on, "left_semi").dropDuplicates(on)
    every = kept.join(repeated, on, "left_anti").select("row").unionByName(again.select("row"))
    return every.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, words: int = 4, seed: int = 42, limit: int = 4, depth: int = 2, broadcast_rows: int = 200_000) -> DataFrame:
    """The documents with one of each class left, that with the smallest doc_id, as they were; see keep_first()."""
    found = classes(fingerprints(docs, words, seed).where("doc_id is not null"), limit, depth, broadcast_rows)
    return keep_first(docs, found.select("doc_id", "digest", "root"), broadcast_rows)
