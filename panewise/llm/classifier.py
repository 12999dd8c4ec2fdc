"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are DataFrame functions; only they reach Python. Trees are fitted on a bounded sample of labelled documents: values are
binned at quantiles, each level's gradients are added up by (node, statistic, bin), and the split of the greatest gain is
taken. The trees are full to their depth and lie in arrays, in heap order, so that a batch of documents goes down all trees
with a few numpy steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.llm._common import WS, written
from panewise.llm.quality import SYMBOLS, words_of

#: Names of the statistics, in order.
STATISTICS = (
    "words", "characters", "word_length", "capitals", "symbols", "bars", "shouts", "digits", "ends", "distinct_words", "repeated_words",
    "marks", "repeated_lines", "line_words", "code", "titles", "doubled_marks", "capital_words",
)


@dataclass(frozen=True)
class Settings:
    """How trees are fitted."""

    #: Labelled documents at most: those with the least hashes of their ids. This bounds what the driver holds.
    sample: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    #: Added to each side's second derivatives, and the least that a side must have.
    shrink: float = 5.0
    least: float = 4.0


@dataclass(frozen=True)
class Forest:
    """Full trees in heap order: a document goes right where its statistic is above the bound."""

    base: float
    statistic: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row of x."""
        trees, inner = self.statistic.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        rows, of = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.statistic[of, at]] > self.bound[of, at])
        return self.base + self.value[of, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def bin_bounds(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column, up to bins - 1 different quantiles; a value belongs to the first bound that it does not exceed."""
    places = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, places, method="lower")) for c in x.T]


def best_splits(codes: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, bins: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistic, bin, gain) of each node's best split: rows of codes up to the bin go left."""
    width = codes.shape[1]
    key = ((node[:, None] * width + np.arange(width)[None, :]) * bins + codes).ravel()
    sums = [np.bincount(key, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for v in (g, h)]
    gl, hl = sums
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    part = lambda a, b: a * a / (b + s.shrink)
    gain = part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht)
    gain = np.where((hl >= s.least) & (ht - hl >= s.least), gain, 0.0).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    return best // bins, best % bins, gain[np.arange(nodes), best]


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Forest:
    """Trees for the rows of x with labels y (0 to 1); without rows, or with one label only, no tree and a smoothed constant."""
    mean = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(mean / (1 - mean))), 2**s.depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    bounds = bin_bounds(x, s.bins)
    codes = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T)], axis=1)
    raw, statistics, limits, values = np.full(len(y), base), [], [], []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), dtype=np.int64)
        statistic, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(s.depth):
            first = 2**level - 1
            which, upto, gain = best_splits(codes, node, first + 1, g, h, s.bins, s)
            cut = np.where(gain > 1e-9, upto, s.bins)  # no gain: all rows go left
            for k in np.flatnonzero(gain > 1e-9).tolist():
                statistic[first + k], limit[first + k] = which[k], bounds[which[k]][upto[k]]
            node = 2 * node + (codes[np.arange(len(y)), which[node]] > cut[node])
        leaf = -s.rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + s.shrink)
        raw = raw + leaf[node]
        statistics.append(statistic)
        limits.append(limit)
        values.append(leaf)
    return Forest(base, np.stack(statistics), np.stack(limits), np.stack(values))


def statistics(text: Column) -> Column:
    """array<double> of STATISTICS of a text (null: empty)."""
    t, w, lines = F.col("t"), F.col("w"), F.col("l")
    n, chars = F.greatest(F.size(w), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    only = lambda characters: F.length(F.regexp_replace(t, f"[^{characters}]+", ""))
    numbers = {
        "words": F.log1p(F.size(w)), "characters": F.log1p(F.length(t)), "word_length": F.length(F.array_join(w, "")) / n, "capitals": without(r"\p{Lu}+") / chars,
        "symbols": only(SYMBOLS) / n, "bars": only("|") / n, "shouts": only("!?") / n, "digits": only("0-9") / chars, "ends": only(".!?") / n,
        "distinct_words": F.size(F.array_distinct(w)) / n, "repeated_words": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) / n,
        "marks": F.length(F.regexp_replace(t, rf"[\p{{L}}{WS}]+", "")) / chars, "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": F.log1p(F.size(w) / F.greatest(F.size(lines), F.lit(1))), "code": only(r"{}=;_/\\\\") / chars, "titles": F.regexp_count(t, F.lit(r"(?<!\p{L})\p{Lu}\p{Ll}")) / n,
        "doubled_marks": F.regexp_count(t, F.lit(rf"([^\p{{L}}\p{{N}}{WS}])\1")) / n, "capital_words": F.regexp_count(t, F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")) / n,
    }
    return F.array(*[numbers[k].cast("double") for k in STATISTICS])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row of docs."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), t.alias("t"), words_of(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS}]")).alias("l"))
    return rows.select("doc_id", statistics(F.col("t")).alias("x"))


def held_out(doc_id: Column) -> Column:
    """Every third document, by the CRC-32 of its id, lends its label to no fit; one without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(rows: DataFrame, labels: DataFrame, label_col: str = "quality", s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most s.sample documents that are not held out.

    An id counts once: with the mean of its labels and the least of its rows' statistics. Labels that are null do not count.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = known.join(rows.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    drawn = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample), "labels-drawn")
    found = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas().sort_values("doc_id")
    if not len(found):
        return np.zeros((0, len(STATISTICS))), np.zeros(0)
    return np.stack(found["x"].to_numpy()).astype(float), found["y"].to_numpy(dtype=float)


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of measured()."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in given:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of docs, null ids, repeated rows and empty texts too.

    score: how likely label 1 is; predicted: 1 from 0.5 on. Of docs only doc_id and text are read, of labels only doc_id and
    quality. Without usable labels every score is 0.5, with one label only the same constant everywhere. An empty table gives no rows.
    """
    rows = written(measured(docs), "statistics")
    forest = fit(*training_rows(rows, labels, s=s), s)
    found = scored(rows, forest)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
