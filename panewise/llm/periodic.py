"""Periodic runs of words: Main-Lorentz divide and conquer over interned word ids.

A run is a stretch of words with a smallest period q, at least `least` words and `times` periods long, that no neighbouring
word extends. A text is halved again and again. Runs that cross or touch a middle come from two Z-functions: how far the
words after the middle repeat, and how far those before it do, for every distance to it. A run found in a segment counts if
it ends inside it (or with the text): one that reaches a segment's end crosses a middle further up and is found there whole.
Stretches are kept with their smallest period.

In a run of three periods or more, every stretch of `GRAM` words comes again in the same text. Words outside such stretches
are in no run, so that only the stretches are searched: this loses nothing and passes over most texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.llm._common import WS
from panewise.llm.pieces import batches
from panewise.llm.quality import words_of

#: Least words of a run, least periods, and words of the stretches that must come again.
LEAST, TIMES, GRAM = 24, 3, 8
#: Rows and bytes of text of a batch at most, unless one text has more.
ROWS, BYTES = 1024, 2 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

Run = tuple[int, int, int]


def z_function(s: np.ndarray) -> np.ndarray:
    """For each place, how many symbols from there on equal those from the start on (at place 0: all)."""
    n = len(s)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    values, z, low, high = s.tolist(), {}, 0, 0
    for i in np.flatnonzero(s == s[0]).tolist()[1:]:
        k = min(high - i, z.get(i - low, 0)) if i < high else 0
        while i + k < n and values[k] == values[i + k]:
            k += 1
        if i + k > high:
            low, high = i, i + k
        z[i] = k
    out[0] = n
    if z:
        out[np.fromiter(z, np.int64, len(z))] = np.fromiter(z.values(), np.int64, len(z))
    return out


def _crossing(ids: np.ndarray, low: int, middle: int, high: int, least: int, times: int, out: dict[tuple[int, int], int]) -> None:
    """Adds to `out` (start, end) -> smallest period of the runs of ids[low:high] that cross or touch the middle."""
    wall = np.full(1, -1, dtype=ids.dtype)
    left, right, both = ids[low:middle], ids[middle:high], ids[low:high]
    a, b = len(left), len(right)
    ahead = z_function(np.concatenate([right, wall, both]))
    back = z_function(np.concatenate([left[::-1], wall, both[::-1]]))
    ahead[0], back[0] = b, a
    for whole, other in ((b, False), (a, True)):
        p = np.arange(1, min(whole, (high - low) // times) + 1)
        if not other:  # words from the middle on, and p further
            start = middle - back[a + 1 + b - p]
            end = middle + p + np.where(p < b, ahead[np.minimum(p, b - 1)], 0)
        else:  # words up to the middle, and p before
            start = middle - p - np.where(p < a, back[np.minimum(p, a - 1)], 0)
            end = middle + ahead[b + 1 + a - p]
        found = (end - start >= np.maximum(least, times * p)) & ((start > low) | (low == 0)) & ((end < high) | (high == len(ids)))
        for s, e, q in zip(start[found].tolist(), end[found].tolist(), p[found].tolist()):
            if out.get((s, e), q + 1) > q:
                out[s, e] = q


def main_lorentz(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of all runs."""
    out: dict[tuple[int, int], int] = {}
    todo = [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        if high - low < max(least, 2):
            continue
        middle = (low + high) // 2
        _crossing(ids, low, middle, high, least, times, out)
        todo += [(low, middle), (middle, high)]
    return out


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(start, end) outside of which no run has a word: where every GRAM words come again."""
    if times < 3 or 3 * GRAM - 5 > least:
        return [(0, len(ids))]
    n = len(ids) - GRAM + 1
    if n <= least - GRAM:
        return []
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    h ^= h >> np.uint64(29)
    order = np.sort(h)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return []
    marked = np.concatenate([[0], np.isin(h, again), [0]]).astype(np.int8)
    change = np.diff(marked)
    found = zip(np.flatnonzero(change == 1).tolist(), (np.flatnonzero(change == -1) + GRAM - 1).tolist())
    return [(s, e) for s, e in found if e - s >= least]


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of all runs, by start, then period. Words may be of any hashable kind."""
    if len(words) < least:
        return []
    index = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    out = []
    for low, high in stretches(ids, least, times):
        out += [(low + s, e - s, q) for (s, e), q in main_lorentz(ids[low:high], least, times).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[Run]) -> list:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES, text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): a row for each row of docs, null ids and repeated rows too.

    runs: array of (start, length, period), by start, then period. collapsed: the text's words, joined by one space, without
    those that repeat within a run. A null text counts as empty. An empty table gives no rows; columns besides doc_id and the
    text are not read. Texts are read whole; a task holds one batch of texts, or one longer text, and its word ids.
    """

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in (b for whole in given for b in batches([whole], ROWS, BYTES)):
            found, texts = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # bytes split at the six characters of WS
                runs = runs_of(words, least, times)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(kept_words(words, runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the CRC-32 h of its id, repeats some of its words up to its end.

    Of its n words, with g = h // 10, all from a = g mod n on become those from a on again and again, 1 + (n - a) // (3 + g mod 8) of them.
    """
    n, h = F.size("w"), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"))
    a = F.pmod(F.col("g"), n).cast("int")
    rows = rows.withColumn("a", F.when(n > 0, a)).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _best() -> Column:
    """Of a row's runs that with the most periods, the first among equals."""
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate("runs", none, lambda a, r: F.when(more(a, r), r).otherwise(a))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic()."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.withColumn("b", _best())
    numbers = [F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")]
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *numbers, F.expr("1000 * b.length div b.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: planted(), periodic() and digest() in DuckDB's SQL. Equal GRAM-word stretches at a distance q that follow each other are a
#: stretch of period q; of several periods of one stretch the smallest counts.
PERIODIC_SQL = r"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
o AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM documents, tab),
a AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM o),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) END AS ws FROM p),
g AS (SELECT r, n, unnest(range(n - 7)) AS i, unnest(list_transform(range(n - 7), lambda i: hash(ws[i + 1:i + 8]))) AS g FROM w WHERE n >= 24),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1) x JOIN g y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
l AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k, i FROM e),
m AS (SELECT r, q, min(i) AS s, count(*) + 7 + q AS n FROM l GROUP BY r, q, k HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
u AS (SELECT r, s, n, min(q) AS q FROM m GROUP BY ALL),
b AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t, list({'s': s, 'n': n, 'q': q} ORDER BY s, q) AS runs FROM u GROUP BY r),
x AS (SELECT r, list_reduce(runs, lambda x, y: CASE WHEN y.n * x.q > x.n * y.q THEN y ELSE x END) AS best FROM b),
d AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM u),
k AS (SELECT r, list(i) AS gone FROM d GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, (1000 * best.n // best.q) AS exponent_milli, sha256(coalesce(b.t, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(w.n), lambda i: NOT list_contains(gone, i)), lambda i: ws[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM w LEFT JOIN b USING (r) LEFT JOIN x USING (r) LEFT JOIN k USING (r)
"""
