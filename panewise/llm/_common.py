"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.storage import bounded_broadcast, new_path, written

__all__ = ["WS", "bounded_broadcast", "connected", "few_or_shuffled", "new_path", "shuffled", "written"]

#: Inside a regular expression's brackets: the white space of the contracts.
WS = r"\x20\x09-\x0D"
#: Edges up to which Spark may choose how the rounds of connected() join.
EDGES = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that it be joined by shuffle and merge.

    Spark's estimate of a size leaves out that explode() gives many rows for one, and takes written tables at the size of their packed
    files. Below spark.sql.autoBroadcastJoinThreshold by such an estimate, millions of rows would be broadcast from the driver's memory.
    """
    return df.hint("merge")


def few_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """bounded_broadcast(), but a table of more rows is joined by shuffle and merge, whatever size Spark takes it for."""
    few = bounded_broadcast(df, rows)
    return shuffled(df) if few is df else few


def connected(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of the edges (u, v), longs: root is the smallest node of its component.

    Alternating large-star and small-star rounds; each round aggregates by node with partial minima, so that a hub's edges
    never meet in one task as a group, and is written to the shared folder. No edges: an empty table.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    pairs = written(pairs, name)
    before = state(pairs)
    while True:
        held = shuffled if before[0] > EDGES else lambda df: df
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = held(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = held(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        pairs = written(small, name)
        now = state(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
