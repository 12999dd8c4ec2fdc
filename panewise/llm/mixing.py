"""Mixing sources by temperature, within a budget of tokens.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1 (as they are),
normalised. The exponent is found by bisection, on a grid of millionths: the largest whose weights have a target entropy, or
the smallest with which no source has to be repeated more often than a limit. A source's quota of the budget is realised in
blocks: whole permutations of its documents, and of a last one as many as fit.

Nothing here needs the documents of a source, or all sources, in one place: a pass of the bisection is one aggregate over the
table of sources, and the last block's end is found from sums over ranges of the permutation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm._common import bounded_broadcast, written
from panewise.llm.quality import words_of

GRID = 1_000_000
#: Levels of the bisection that one pass over the sources decides.
LEVELS = 4
#: Ranges of the permutation by which the end of a last block is found, as digits of 16.
RANGE_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Either `entropy` (in nats) or `repetitions` is met. budget: tokens, or None for the least with which every document is taken."""

    entropy: float | None = None
    repetitions: float | None = 2.0
    budget: int | None = None
    seed: int = 0
    broadcast_sources: int = 100_000


def word_tokens(text: Column) -> Column:
    """Words of a text as its tokens, at least 1; a null text has 1."""
    return F.greatest(F.size(words_of(F.coalesce(text.cast("string"), F.lit("")))), F.lit(1)).cast("long")


def bisect(holds: Callable[[list[int]], list[bool]]) -> int:
    """The smallest point of 0 .. GRID from which on `holds`; GRID if there is none. holds decides several points at once."""
    low, high = 0, GRID
    while low < high:
        points = sorted({low + (high - low) * i // (1 << LEVELS) for i in range(1 << LEVELS)})
        held = holds(points)
        first = next((i for i, h in enumerate(held) if h), None)
        if first is None:
            low = points[-1] + 1
        else:
            low, high = (points[first - 1] + 1 if first else points[0]), points[first]
    return low


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The exponent for the sources (source, total)."""
    least, most, total = sources.agg(F.min("total"), F.max("total"), F.sum("total")).first()
    if not total:
        return 1.0
    share = F.log(F.col("total").cast("double") / float(total))

    def sums(points: list[int]) -> list[tuple[float, float]]:
        """Sum of p^a and of p^a ln p for each exponent."""
        power = [F.exp(share * (a / GRID)) for a in points]
        row = sources.agg(*[F.sum(p) for p in power], *[F.sum(p * share) for p in power]).first()
        return list(zip(row[: len(points)], row[len(points) :]))

    if mix.entropy is not None:
        # The entropy of p^a / z is ln z - a / z * sum p^a ln p; it falls as a grows, so that it is met up to one point.
        under = lambda points: [math.log(z) - a / GRID * s / z < mix.entropy for a, (z, s) in zip(points, sums(points))]
        found = bisect(under)
        return found / GRID if found == 0 or found == GRID and not under([GRID])[0] else (found - 1) / GRID
    low, high = math.log(least / total), math.log(most / total)
    limit = math.log(mix.repetitions) + 1e-12

    def enough(points: list[int]) -> list[bool]:
        """The source that is repeated most, that with the smallest share, stays within the limit."""
        if mix.budget is None:
            return [(1 - a / GRID) * (high - low) <= limit for a in points]
        return [math.log(mix.budget / total) + (a / GRID - 1) * low - math.log(z) <= limit for a, (z, _) in zip(points, sums(points))]

    return bisect(enough) / GRID


def quotas(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, total, weight, quota, blocks, rest): whole blocks and the tokens of a last one that make up a source's quota."""
    a = exponent(sources, mix)
    total = sources.agg(F.sum("total")).first()[0] or 0
    power = F.pow(F.col("total").cast("double") / float(max(total, 1)), F.lit(a))
    weighed = sources.withColumn("power", power)
    z, cover = weighed.agg(F.sum("power"), F.max(F.col("total") / F.col("power"))).first()
    scale = (mix.budget / z) if mix.budget is not None and z else (cover or 0.0)
    quota = F.round(F.col("power") * scale).cast("long")
    rows = weighed.withColumn("weight", F.col("power") / (z or 1.0)).withColumn("quota", quota)
    return rows.withColumn("blocks", F.expr("quota div total").cast("int")).withColumn("rest", F.col("quota") % F.col("total")).drop("power")


def place(block: Column, seed: int, identity: Column) -> Column:
    """Place of a document in a block's permutation, as 15 hex digits."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(identity.cast("string"), F.lit("")))), 1, 15)


def mixed(rows: DataFrame, mix: Mix = Mix(), tokens_col: str = "_tokens") -> DataFrame:
    """The written table rows (doc_id, source, tokens and others) with _block and _place, a row for each use of a document.

    A null source is a source of its own. Every row counts, repeated ones too; rows with null ids have equal places. In the
    last block rows are taken in the order of places (equal ones by tokens, then by _tie if rows have it) while their tokens
    fit into the rest.
    """
    tokens = F.col(tokens_col)
    sources = rows.groupBy("source").agg(F.sum(tokens).alias("total"))
    sources = written(quotas(written(sources, "mix-totals"), mix), "mix-quotas")
    plan = sources.select(F.col("source").alias("_source"), F.col("blocks").alias("_blocks"), F.col("rest").alias("_rest"))
    same = lambda plan: F.col("source").eqNullSafe(F.col("_source"))
    found = rows.join(bounded_broadcast(plan, mix.broadcast_sources), same(plan)).drop("_source")
    whole = found.where("_blocks > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    whole = whole.withColumn("_place", place(F.col("_block"), mix.seed, F.col("doc_id")))

    last = found.where("_rest > 0").withColumn("_block", F.col("_blocks"))
    last = last.withColumn("_place", place(F.col("_block"), mix.seed, F.col("doc_id"))).withColumn("_range", F.substring("_place", 1, RANGE_DIGITS))
    ranges = last.groupBy("source", "_rest", "_range").agg(F.sum(tokens).alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range"))
    ranges = written(ranges.withColumn("_to", upto), "mix-ranges")
    cut = ranges.where(F.col("_to") > F.col("_rest")).groupBy("source").agg(F.min(F.struct("_range", (F.col("_to") - F.col("_sum")).alias("_before"))).alias("_cut"))
    cut = cut.select(F.col("source").alias("_source"), "_cut._range", "_cut._before").withColumnRenamed("_range", "_cut_range")
    last = last.join(bounded_broadcast(written(cut, "mix-cuts"), mix.broadcast_sources), same(cut), "left").drop("_source")
    inside = last.where(F.col("_cut_range").isNull() | (F.col("_range") < F.col("_cut_range")))
    edge = last.where(F.col("_range") == F.col("_cut_range"))
    run = F.col("_before") + F.sum(tokens).over(Window.partitionBy("source").orderBy("_place", tokens, *["_tie"] * ("_tie" in rows.columns)).rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("_run", run).where(F.col("_run") <= F.col("_rest"))
    columns = [*rows.columns, "_block", "_place"]
    return whole.select(*columns).unionByName(inside.select(*columns)).unionByName(edge.select(*columns))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents, each as often as the mix takes it; an empty table gives no rows. Columns are as in docs, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_tokens(F.col("text")).alias("_tokens"), F.xxhash64(F.col("text").cast("string")).alias("_tie"))
    return mixed(written(rows, "mix-docs"), mix).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def schedule(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, tokens, block, place): the order of use is by block, then place. Columns besides doc_id, source and text are not read."""
    rows = written(docs.select("doc_id", "source", word_tokens(F.col("text")).alias("_tokens")), "mix-rows")
    return mixed(rows, mix).select("doc_id", "source", F.col("_tokens").alias("tokens"), F.col("_block").alias("block"), F.col("_place").alias("place"))


#: schedule() with the default mix in DuckDB's SQL.
SCHEDULE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source,
  greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')), 1)::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS total FROM t GROUP BY 1),
g AS (SELECT sum(total)::DOUBLE AS n, ln(min(total) / sum(total)) AS low, ln(max(total) / sum(total)) AS high FROM s),
a AS (SELECT n, CASE WHEN high - low <= ln(2.0) THEN 0 ELSE ceil((1 - (ln(2.0) + 1e-12) / (high - low)) * 1e6) / 1e6 END AS a FROM g),
w AS (SELECT source, total, pow(total / n, a) AS p FROM s, a),
q AS (SELECT source, total, round(p * (SELECT max(total / p) FROM w))::BIGINT AS quota FROM w),
b AS (SELECT source, quota // total AS blocks, quota % total AS rest FROM q),
f AS (SELECT t.*, unnest(range(0, blocks + 1))::INTEGER AS block, blocks, rest FROM t JOIN b ON t.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, substr(md5('0:' || block || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS place FROM f),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY place, tokens ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT doc_id, source, tokens, block, place FROM c WHERE block < blocks OR run <= rest
"""
