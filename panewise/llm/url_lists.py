"""URL filters with a history: each capture is judged by the list entries that were active when it was fetched.

Dated changes of a list (an entry is added or removed) become validity intervals. A capture's address gives the keys that an
entry can match it by: its host, every parent domain, and the host with each leading part of the path. Captures and
intervals meet by key and calendar month in an equality join and keep the intervals that hold on the day of the fetch (an
as-of join). The most specific entry decides; of equally specific ones an allowing entry does.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm._common import bounded_broadcast, written
from panewise.llm.html_text import host

CHANGES = "entry string, kind string, action string, day date"


def intervals(changes: DataFrame) -> DataFrame:
    """(entry, kind, since, until) of the changes (entry, kind block|allow, action add|remove, day): until is exclusive, null if open.

    Entries are compared in lower case without a final slash or dot. On one day an addition outweighs a removal; repeated
    additions or removals change nothing; changes without entry, day or a known action and kind are ignored.
    """
    entry = F.regexp_replace(F.lower(F.trim("entry")), r"[/.]+$", "")
    known = changes.select(entry.alias("entry"), "kind", "day", F.col("action").alias("_action")).where(F.col("entry") != "")
    known = known.where(F.col("day").isNotNull() & F.col("kind").isin("block", "allow") & F.col("_action").isin("add", "remove"))
    days = known.groupBy("entry", "kind", "day").agg(F.max(F.col("_action") == "add").alias("on"))
    order = Window.partitionBy("entry", "kind").orderBy("day")
    turns = days.withColumn("before", F.coalesce(F.lag("on").over(order), F.lit(False))).where(F.col("on") != F.col("before"))
    return turns.withColumn("until", F.lead("day").over(order)).where("on").select("entry", "kind", F.col("day").alias("since"), "until")


def keys(url: Column) -> Column:
    """Array of (key, rank) by which entries can match an address; a higher rank is more specific. No host: an empty array.

    `h` is the host: it, its parent domains, then the host with one path part after the other (without query and fragment).
    """
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (F.size(labels) - i + 1).alias("rank")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.array_remove(F.split(F.lower(path), "/"), "")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"), (F.lit(1000) + i).alias("rank")))
    return F.when(name == "", F.array().cast("array<struct<key:string,rank:int>>")).otherwise(F.concat(domains, F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))))


def judge(captures: DataFrame, changes: DataFrame, url_col: str = "url", day_col: str = "fetched", broadcast_rows: int = 100_000) -> DataFrame:
    """captures with decision (block, allow or none), entry, since, until: the entry that decided on the day of the fetch.

    Equal addresses of a day are judged once. A null address or day, and an address without a host, match nothing: decision
    none. Every row stays, repeated ones too, with all its columns but of these four names, which are replaced. An empty list decides nothing.
    """
    kept = [c for c in captures.columns if c not in ("decision", "entry", "since", "until")]
    rows = captures.select(F.struct(*kept).alias("row"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("day"))
    asked = rows.select("url", "day").where("url is not null and day is not null").distinct()
    last = rows.agg(F.max("day")).first()[0] or datetime.date(1970, 1, 1)
    active = intervals(changes).where(F.col("since") <= F.lit(last))
    end = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last)), F.lit(last))
    months = F.sequence(F.trunc("since", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    active = written(active.withColumn("month", F.explode(months)), "url-intervals")
    looked = asked.select("url", "day", F.trunc("day", "month").alias("asked_month"), F.explode(keys(F.col("url"))).alias("k"))
    # Most keys are on no list; above all the short ones, that very many addresses share, mostly go here.
    listed = bounded_broadcast(written(active.select(F.col("entry").alias("listed")).distinct(), "url-entries"), broadcast_rows)
    looked = looked.join(listed, F.col("k.key") == F.col("listed"), "left_semi")
    hits = looked.join(bounded_broadcast(active, broadcast_rows), (F.col("k.key") == F.col("entry")) & (F.col("asked_month") == F.col("month")))
    hits = hits.where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = hits.groupBy(F.col("url").alias("best_url"), F.col("day").alias("best_day")).agg(F.max(F.struct(F.col("k.rank"), (F.col("kind") == "allow").alias("allow"), "entry", "kind", "since", "until")).alias("best"))
    rows = rows.join(best, (F.col("url") == F.col("best_url")) & (F.col("day") == F.col("best_day")), "left")
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], F.coalesce("best.kind", F.lit("none")).alias("decision"), "best.entry", "best.since", "best.until")


#: Changes that are drawn for each string of the sample list, and days over which they are spread.
DRAWS, FIRST_DAY, DAYS = 24, "2023-07-01", 540


def drawn_list(pages: DataFrame) -> DataFrame:
    """A list of changes (entry, kind, action, day) drawn by a rule from the pages' own addresses: no list comes with the tables.

    Hosts, their parent domains of two labels or more and hosts with the first part of a path get up to DRAWS changes each,
    by the digits of an MD5 hash: additions, removals, repeated ones of both, blocking and allowing.
    """
    url = F.col("url").cast("string")
    name = host(url)
    part = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+([^/]+)", 1))
    parent = F.regexp_extract(name, r"^[^.]+\.([^.]+\..+)$", 1)
    strings = F.array(name, parent, F.when(part != "", F.concat(name, F.lit("/"), part)).otherwise(""))
    entries = pages.where(name != "").select(F.explode(strings).alias("entry")).where("entry <> ''").distinct()
    draws = entries.select("entry", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))).alias("n"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "entry", F.col("n").cast("string"))), 1, 7), 16, 10).cast("long")
    draws = draws.withColumn("x", number).where(F.col("x") % 16 < 3)
    digit = lambda by, of: F.floor(F.col("x") / by).cast("long") % of
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), digit(1024, DAYS).cast("int"))
    return draws.select("entry", F.when(digit(16, 4) == 0, "allow").otherwise("block").alias("kind"), F.when(digit(64, 3) == 0, "remove").otherwise("add").alias("action"), day.alias("day"))


def dated(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched): pages have no fetch time, so that the query gives each a day of 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


JUDGE_SQL = rf"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
s AS (SELECT h AS entry FROM p WHERE h <> '' UNION SELECT regexp_extract(h, '^[^.]+\.([^.]+\..+)$', 1) FROM p
  UNION SELECT h || '/' || regexp_extract(path, '^/+([^/]+)', 1) FROM p WHERE h <> '' AND regexp_extract(path, '^/+([^/]+)', 1) <> ''),
n AS (SELECT entry, ('0x' || substr(md5(entry || ':' || n), 1, 7))::BIGINT AS x FROM s, range(1, {DRAWS + 1}) r(n) WHERE entry <> ''),
c AS (SELECT entry, CASE WHEN x // 16 % 4 = 0 THEN 'allow' ELSE 'block' END AS kind, x // 64 % 3 <> 0 AS added,
  DATE '{FIRST_DAY}' + (x // 1024 % {DAYS})::INTEGER AS day FROM n WHERE x % 16 < 3),
d AS (SELECT regexp_replace(trim(entry), '[/.]+$', '') AS entry, kind, day, bool_or(added) AS listed FROM c GROUP BY ALL),
t AS (SELECT *, coalesce(lag(listed) OVER z, false) AS before FROM d WINDOW z AS (PARTITION BY entry, kind ORDER BY day)),
v AS (SELECT entry, kind, day AS since, listed, lead(day) OVER (PARTITION BY entry, kind ORDER BY day) AS until FROM t WHERE listed <> before),
m AS (SELECT page_id, url, fetched, v.*, row_number() OVER (PARTITION BY page_id, url ORDER BY contains(entry, '/') DESC, length(entry) DESC, kind) AS r
  FROM p JOIN v ON listed AND since <= fetched AND (until IS NULL OR fetched < until)
  AND (h = entry OR ends_with(h, '.' || entry) OR starts_with(h || rtrim(path, '/') || '/', entry || '/') AND contains(entry, '/')))
SELECT p.page_id, p.url, p.fetched, coalesce(m.kind, 'none') AS decision, m.entry, m.since, m.until
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url = m.url AND m.r = 1
"""
