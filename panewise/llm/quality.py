"""Quality rules on documents and on their hosts, in DataFrame functions only.

Documents are measured one by one. Their rule failures are added up by host (the column `source`); a host's rate of
failures is shrunk by a beta prior whose two parameters come from all hosts by the method of moments. A host is rejected with
all its documents if its shrunken rate is above a limit, or if it is surely some times the mean rate (the lower end of its
posterior is) and not small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.llm._common import WS, bounded_broadcast, written

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """What fails a document, and from which shrunken failure rate on a host is rejected."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 30
    max_dup_line_percent: int = 50
    max_host_rate: float = 0.5
    #: The other way for a host to be rejected: this many times the mean rate, with so many standard deviations of the
    #: posterior to spare, at a shrunken rate of at least min_host_rate.
    host_multiple: float = 2.0
    host_deviations: float = 3.0
    min_host_rate: float = 0.3
    #: Bounds of the prior's weight in documents: hosts that hardly differ, or differ as much as can be.
    min_prior: float = 2.0
    max_prior: float = 1e6
    #: More rejected hosts than this are joined by a shuffle, not a broadcast.
    broadcast_hosts: int = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often the body names it, inside lambdas too."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WS}]+"), "")


def repeat_words(words: Column, width: int = 8) -> Column:
    """How many words stand in a window of `width` words that is found twice or more in the array, the first one included.

    Windows are compared by a 64-bit hash of their words' hashes. Sorted with their places, equal ones are neighbours; only
    texts with any repeat pay for the sort.
    """
    n = F.size(words)
    windows = lambda h: F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        equal = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
        found = let(pairs, lambda s: F.filter(s, lambda e, k: equal(e, F.get(s, k - 1)) | equal(e, F.get(s, k + 1))))
        places = F.sort_array(F.transform(found, lambda e: e["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("sum"))
        step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(p - a["last"], F.lit(width))).alias("sum"))
        return F.aggregate(places, start, step, lambda a: a["sum"])

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)))
    return F.when(n >= width, found).otherwise(0)


def measured(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """(row, q): docs' columns as one struct, whatever their names, and what was measured.

    q is a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, rule_failed. A null
    text counts as empty: no words, so it fails.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    df = docs.select(F.struct("*").alias("row"), words_of(text).alias("w"), lines.alias("l"), F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("s"))
    numbers = {
        "n_words": F.size("w"), "word_chars": F.length(F.array_join("w", "")), "n_symbols": F.col("s"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")), "n_repeat_words": repeat_words(F.col("w")), "n_lines": F.size("l"),
    }
    df = df.select("row", F.struct(*[v.cast("long").alias(k) for k, v in numbers.items()]).alias("n"))
    x = F.col("n")
    base = (x["n_words"] < limits.min_words) | (100 * x["n_repeat_words"] > limits.max_repeat_percent * x["n_words"])
    rule = base | (100 * x["n_symbols"] > limits.max_symbol_percent * x["n_words"]) | (100 * x["n_dup_lines"] > limits.max_dup_line_percent * x["n_lines"])
    return df.select("row", F.struct(*[x[k].alias(k) for k in numbers], base.alias("base_failed"), rule.alias("rule_failed")).alias("q"))


def host_rates(flags: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, n, failed, rate, rejected) of the rows (host, failed boolean); rows without a host take no part.

    The prior has the mean m of all documents and a weight w from the spread of the hosts' rates beyond chance:
    v = (sum n (p - m)^2 - (hosts - 1) m (1 - m)) / (N - sum n^2 / N), w = m (1 - m) / v - 1, within the limits' bounds.
    rate = (failed + m w) / (n + w), with the posterior's variance rate (1 - rate) / (n + w + 1).
    """
    hosts = flags.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
    hosts = written(hosts, "hosts")
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    t = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("n2"), F.sum(f * f / n).alias("fp")).first()
    mean = t["f"] / t["n"] if t["n"] else 0.0
    spread, chance = (t["fp"] or 0.0) - (t["n"] or 0.0) * mean * mean, mean * (1 - mean)
    room = t["n"] - t["n2"] / t["n"] if t["n"] else 0.0
    between = (spread - (t["hosts"] - 1) * chance) / room if room > 0 else 0.0
    weight = min(limits.max_prior, max(limits.min_prior, chance / between - 1)) if between > 0 else limits.max_prior
    rate = F.col("rate")
    sure = rate - limits.host_deviations * F.sqrt(rate * (1 - rate) / (n + weight + 1)) > limits.host_multiple * mean
    rejected = (rate > limits.max_host_rate) | (sure & (rate > limits.min_host_rate))
    return hosts.withColumn("rate", (f + mean * weight) / (n + weight)).withColumn("rejected", rejected)


def _with_verdicts(rows: DataFrame, limits: Limits) -> DataFrame:
    """The written table rows (host, rule_failed and others) with host_rejected: the verdict on the row's host."""
    hosts = host_rates(rows.select("host", F.col("rule_failed").alias("failed")), limits)
    bad = hosts.where("rejected").select(F.col("host").alias("bad_host"))
    found = rows.join(bounded_broadcast(bad, limits.broadcast_hosts), F.col("host") == F.col("bad_host"), "left")
    return found.withColumn("host_rejected", F.col("bad_host").isNotNull()).drop("bad_host")


def assess(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, source, the numbers, base_failed, rule_failed, host_rejected, kept): a row for each row of docs, repeated ones too.

    Null ids and hosts stay; a document without a host is judged by its own rules only. An empty table gives no rows. Columns
    besides doc_id, text and source are not read.
    """
    rows = measured(docs.select("doc_id", "source", "text"), limits).select("row.doc_id", F.col("row.source").alias("host"), "q.*")
    rows = _with_verdicts(written(rows, "quality"), limits)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).withColumnRenamed("host", "source")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, as they were; nulls and empty tables as in assess().

    Of documents that fail by themselves only the host and the failure are written.
    """
    rows = measured(docs, limits)
    fine = ~F.col("q.base_failed")
    rows = rows.select(F.col("row")["source"].alias("host"), "q.rule_failed", F.when(fine, F.col("row")).alias("row"))
    rows = _with_verdicts(written(rows, "quality-docs"), limits)
    return rows.where(F.col("row").isNotNull() & ~F.col("host_rejected")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


#: The same in DuckDB's SQL, with the default limits.
ASSESS_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g
  FROM w WHERE len(ws) >= 8),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, sum(least(8, i - p)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8) AS p FROM dup) GROUP BY r),
m AS (SELECT r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines AS rule_failed FROM b),
h AS (SELECT source AS host, count(*)::DOUBLE AS n, count(*) FILTER (rule_failed)::DOUBLE AS f FROM f WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT count(*) AS hosts, sum(n) AS n, sum(f) / sum(n) AS m, sum(n * n) AS n2, sum(f * f / n) AS fp FROM h),
v AS (SELECT m, (fp - n * m * m - (hosts - 1) * m * (1 - m)) / nullif(n - n2 / n, 0) AS v FROM a),
p AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(2, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM v),
r AS (SELECT host, m, n, k, (f + m * k) / (n + k) AS rate FROM h, p),
bad AS (SELECT host FROM r WHERE rate > 0.5 OR rate > 0.3 AND rate - 3.0 * sqrt(rate * (1 - rate) / (n + k + 1)) > 2.0 * m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT host FROM bad), true) AS kept FROM f
"""
