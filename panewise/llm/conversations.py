"""Repair of conversations: a forward Viterbi search over the grammar of turns, for each conversation.

Roles, by their first letters, should read `(s?(ua)+)?`: nothing, or user and assistant in turns, with a system turn ahead at most.
Four states say where in the grammar a prefix ends: START, SYSTEM, USER, ASSISTANT. Each turn is kept, given another role or
deleted; after each turn's layer empty turns may be inserted, by two relaxations (more would go round in a circle). A state
carries its cheapest (cost, audit string), ties by the string; two of equal cost are never prefixes of each other, so that
the cheapest of parts make the cheapest whole.

A conversation of any length is no one task's group: rows are dealt by ranges of (conversation, turn) and streamed in order.
What lies within a task is solved at once. Of a conversation that reaches over a task's end, or is long, each part gives a
matrix of the cheapest ways from each state to each state; the few parts' matrices are multiplied. Only its hash, sequential
by nature, then reads such a conversation's rows as one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.llm._common import WS, bounded_broadcast, written

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Where a turn leads from each state, by the first letter of its role.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where a user or assistant turn leads, whichever the state takes.
EXPECTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows from which on a conversation is long, and characters of text.
LONG, LONG_TEXT = 512, 4 << 20
#: Repeated turns (conversation, role, text) and conversations at task ends that are broadcast at most.
BROADCAST = 100_000

Way = tuple[int, str]
Layer = list["Way | None"]


def _less(a: Way | None, b: Way | None) -> Way | None:
    return b if a is None or b is not None and b < a else a


def closed(layer: Layer) -> Layer:
    """The layer with empty turns inserted after it where that is cheaper."""
    out = list(layer)
    for state in (START, SYSTEM, ASSISTANT):
        if layer[state] is not None:
            out[USER] = _less(out[USER], (layer[state][0] + INSERT, layer[state][1] + "I"))
    if out[USER] is not None:
        out[ASSISTANT] = _less(out[ASSISTANT], (out[USER][0] + INSERT, out[USER][1] + "I"))
    return out


def step(layer: Layer, initial: str, must_go: bool, truncated: bool) -> Layer:
    """The closed layer after one more turn."""
    out: Layer = [None] * 4
    stays, kept = TRUNCATED if truncated else 0, KEEP.get(initial, {})
    for state in STATES:
        if layer[state] is None:
            continue
        cost, audit = layer[state]
        out[state] = _less(out[state], (cost + DELETE, audit + "D"))
        if not must_go:
            if state in kept:
                out[kept[state]] = _less(out[kept[state]], (cost + stays, audit + "K"))
            out[EXPECTED[state]] = _less(out[EXPECTED[state]], (cost + stays + RETYPE, audit + "R"))
    return closed(out)


def first_layer(state: int) -> Layer:
    return [(0, "") if s == state else None for s in STATES]


def product(a: list[Layer], b: list[Layer]) -> list[Layer]:
    """Cheapest ways through two parts after each other."""
    out = []
    for row in a:
        best: Layer = [None] * 4
        for middle in STATES:
            if row[middle] is not None:
                for end in STATES:
                    if b[middle][end] is not None:
                        best[end] = _less(best[end], (row[middle][0] + b[middle][end][0], row[middle][1] + b[middle][end][1]))
        out.append(best)
    return out


def cheapest(layer: Layer) -> Way:
    """Of the ways that end where the grammar may end."""
    return _less(layer[START], layer[ASSISTANT])


class Replay:
    """Hashes the repaired turns of a conversation, given its audit string and its turns one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _put(self, role: str, text: str, state: int) -> None:
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any, self.state = True, state

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(NAMES[EXPECTED[self.state]], "", EXPECTED[self.state])
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text, KEEP[role[:1]][self.state])
        elif edit == "R":
            self._put(NAMES[EXPECTED[self.state]], text, EXPECTED[self.state])

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


@dataclass
class Part:
    """What is known of some turns of a conversation in a row: counts, the turns at both ends, and ways from state to state."""

    order: tuple = ()
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    rows: int = 0
    first: str = ""
    last: str = ""
    #: Matrices of runs of turns, each of more turns than the next: merged like the digits of a binary number.
    ways: list[tuple[int, list[Layer]]] = field(default_factory=list)

    def count(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.distinct += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.illegal += self.rows > 0 and self.last + initial not in LEGAL
        self.first = initial if not self.rows else self.first
        self.last = initial
        self.rows += 1

    def append(self, size: int, matrix: list[Layer]) -> None:
        while self.ways and self.ways[-1][0] <= size:
            before, left = self.ways.pop()
            size, matrix = size + before, product(left, matrix)
        self.ways.append((size, matrix))

    def matrix(self) -> list[Layer]:
        out = None
        for _, matrix in reversed(self.ways):
            out = matrix if out is None else product(matrix, out)
        return out if out is not None else [first_layer(s) for s in STATES]

    def join(self, other: Part) -> None:
        """Adds the part that follows."""
        if other.low is not None:
            self.distinct += other.distinct - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.rows:
            self.illegal += self.rows > 0 and self.last + other.first not in LEGAL
            self.first, self.last = self.first if self.rows else other.first, other.last
        self.rows += other.rows
        self.append(other.rows, other.matrix())

    def counts(self) -> dict:
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


Turn = tuple[str, str, bool, bool]


class Solver:
    """Solves the conversations of a task's rows, which come in order; what may go on in other tasks is given as parts."""

    def __init__(self) -> None:
        self.key: object = self
        self.part, self.held, self.size, self.whole, self.opened = Part(), [], 0, False, False

    def _flush(self) -> None:
        """Held turns become a matrix; their texts are not needed again."""
        matrix = [first_layer(s) for s in STATES]
        for role, _, must_go, truncated in self.held:
            matrix = [step(row, role[:1], must_go, truncated) for row in matrix]
        if self.held:
            self.part.append(len(self.held), matrix)
        self.held, self.size, self.whole = [], 0, False

    def end(self, last: bool) -> dict | None:
        """The result, or the part, of the conversation whose turns came; last: it may go on in another task."""
        if not self.opened:
            return None
        if self.whole and not last:
            layer = closed(first_layer(START))
            for role, _, must_go, truncated in self.held:
                layer = step(layer, role[:1], must_go, truncated)
            cost, audit = cheapest(layer)
            replay = Replay(audit)
            for role, text, _, _ in self.held:
                replay.turn(role, text)
            return {"conv_id": self.key, "done": True, **self.part.counts(), "cost": cost, "audit": audit, "repaired_sha256": replay.digest()}
        self._flush()
        p, ways = self.part, self.part.matrix()
        flat = [w for row in ways for w in row]
        return {
            "conv_id": self.key, "done": False, "turn": p.order[0], "role": p.order[1], "digest": p.order[2], "low": p.low, "high": p.high, "distinct": p.distinct, "rows": p.rows, "first": p.first, "last": p.last,
            "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal, "costs": [w and w[0] for w in flat], "audits": [w and w[1] for w in flat],
        }

    def add(self, key: int | None, turn: int | None, role: str | None, text: str | None, digest: str | None, copies: int, seen: bool, blank: bool, truncated: bool) -> dict | None:
        """A row more; the result of the conversation before, if it is over."""
        out = None
        if not self.opened or key != self.key:
            out, first = self.end(False), not self.opened
            self.key, self.part, self.held, self.size, self.opened = key, Part(order=(turn, role, digest)), [], 0, True
            self.whole = not first  # a task's first conversation may have begun elsewhere
        for k in range(copies):
            repeated = seen or k > 0
            fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else ""
            self.part.count(turn, role[:1], fault)
            self.held.append((role, text, blank or repeated, fault == "truncated"))
            self.size += len(text)
            if len(self.held) >= LONG or self.size >= LONG_TEXT:
                self._flush()
        return out


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PART = "done boolean, turn long, role string, digest string, low long, high long, distinct long, rows long, first string, last string, costs array<long>, audits array<string>"
ROW = ("conv_id", "turn", "role", "text", "digest", "copies", "seen", "blank", "truncated")


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _solved(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solver, schema = Solver(), _arrow(f"{RESULT}, {PART}")
    for batch in given:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ROW]
        found = [r for row in zip(*columns) if (r := solver.add(*row)) is not None]
        if found:
            yield _table(found, schema)
    if (r := solver.end(True)) is not None:
        yield _table([r], schema)


def _merged(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results without hashes from parts in order."""
    schema = _arrow(RESULT)
    key, part = None, None

    def result() -> pa.RecordBatch:
        layer = product([closed(first_layer(START))], part.matrix())[0]
        cost, audit = cheapest(layer)
        return _table([{"conv_id": key, **part.counts(), "cost": cost, "audit": audit}], schema)

    for batch in given:
        for row in batch.to_pylist():
            if part is not None and row["conv_id"] != key:
                yield result()
                part = None
            if part is None:
                key, part = row["conv_id"], Part()
            flat = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
            more = Part(**{n: row[n] for n in ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "rows", "first", "last")})
            more.ways = [(row["rows"], [flat[4 * i : 4 * i + 4] for i in STATES])]
            part.join(more)
    if part is not None:
        yield result()


def _hashed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results with hashes; each conversation's result without one comes ahead of its turns."""
    schema, names = _arrow(RESULT), [x.split(" ")[0] for x in RESULT.split(", ")]
    head, replay = None, None
    for batch in given:
        for row in batch.to_pylist():
            if row["place"] == 0:
                if head is not None:
                    yield _table([{**head, "repaired_sha256": replay.digest()}], schema)
                head, replay = {n: row[n] for n in names}, Replay(row["audit"])
            else:
                for _ in range(row["copies"]):
                    replay.turn(row["role"], row["text"])
    if head is not None:
        yield _table([{**head, "repaired_sha256": replay.digest()}], schema)


def _conversation(name: str = "conv_id") -> Column:
    """A key that is never null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def prepared(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copies, digest, seen, blank, truncated): equal rows as one, with how often they come.

    seen: the role and text came at an earlier turn of the conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    there = F.col("copies") > 0
    rows = rows.withColumns({"role": F.when(there, F.col("role")), "text": F.when(there, F.col("text"))})
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = written(rows.withColumn("digest", F.sha2("text", 256)), "turns")
    first = F.min(F.struct("turn"))
    often = rows.where(there).groupBy(_conversation().alias("_key"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n"), first.alias("_first")).where("_n > 1").drop("_n")
    often = bounded_broadcast(written(often, "repeated-turns"), BROADCAST)
    rows = rows.join(often, (_conversation() == F.col("_key")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    seen = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    blank = ~F.col("text").rlike(f"[^{WS}]")
    return rows.select("conv_id", "turn", "role", "text", "copies", "digest", seen.alias("seen"), blank.alias("blank"), (~F.col("text").rlike(rf"[.!?][{WS}]*\z")).alias("truncated"))


def repair(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation, a null one too.

    turns: (conv_id, turn, role, text); other columns are not read. copies: how often a row stands there (once, if not given);
    a conversation whose rows have no copies is known, but empty: zeros, an empty audit and the hash of nothing. Null roles and
    texts count as one space. Rows come by turn, nulls first, then by role, then by the text's hash. An empty table gives no rows.
    """
    rows = written(prepared(turns, copies), "checked-turns")
    keys = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = written(dealt.mapInArrow(_solved, f"{RESULT}, {PART}"), "conversations")
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    parts = found.where("not done").repartition(F.col("conv_id")).sortWithinPartitions(*keys)
    heads = written(parts.mapInArrow(_merged, RESULT), "conversation-heads")
    known = bounded_broadcast(heads.select(_conversation().alias("_key")), BROADCAST)
    again = rows.join(known, _conversation() == F.col("_key"), "left_semi").where("copies > 0").withColumn("place", F.lit(1))
    both = heads.withColumn("place", F.lit(0)).unionByName(again.select(*keys, "text", "copies", "place"), allowMissingColumns=True)
    both = both.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place", "turn", "role", "digest")
    return found.where("done").select(*names).unionByName(both.mapInArrow(_hashed, RESULT))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with planted faults, by the CRC-32 of `conv_id:turn` modulo 20, and how often each stands there.

    0 drops a turn, 1 empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it, 4 makes it the user's.
    """
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.cast("int").alias("kind"))
    k = F.col("kind")
    rows = rows.withColumns({"text": F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(k == 4, "user").otherwise(F.col("role"))})
    return rows, F.when(k == 0, 0).when(k == 3, 2).otherwise(1)


#: damaged() and repair() in DuckDB's SQL: the layers of all conversations at once, a turn further in each round. A state is a
#: struct (cost, audit, repaired text); the least of structs is the cheapest, ties by the audit.
REPAIR_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT o.*, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS d FROM o, tab),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
s AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS c, left(lag(role) OVER w, 1) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM s),
g AS (SELECT *, blank OR seen AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS stay FROM f),
h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY 1),
v AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 1000000000, 'a': '', 't': ''} AS s1, {'c': 3, 'a': 'I', 't': 'user:'} AS s2, {'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL
SELECT conv_id, i, s0, s1, u, least(s3, {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}) FROM (
  SELECT conv_id, i, s0, s1, s3, least(s2, {'c': s0.c + 3, 'a': s0.a || 'I', 't': s0.t || CASE WHEN s0.t = '' THEN '' ELSE chr(10) END || 'user:'}, {'c': s1.c + 3, 'a': s1.a || 'I', 't': s1.t || chr(10) || 'user:'}, {'c': s3.c + 3, 'a': s3.a || 'I', 't': s3.t || chr(10) || 'user:'}) AS u FROM (
    SELECT v.conv_id, g.i,
      {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} AS s0,
      least({'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}, {'c': CASE WHEN gone OR c <> 's' THEN 1000000000 ELSE s0.c + stay END, 'a': s0.a || 'K', 't': role || ':' || text}) AS s1,
      list_min([{'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t}] || list_transform([s0, s1, s3], lambda x: {'c': CASE WHEN gone OR c <> 'u' THEN 1000000000 ELSE x.c + stay END, 'a': x.a || 'K', 't': x.t || CASE WHEN x.t = '' THEN '' ELSE chr(10) END || role || ':' || text})
        || list_transform([s0, s1, s3], lambda x: {'c': CASE WHEN gone THEN 1000000000 ELSE x.c + stay + 3 END, 'a': x.a || 'R', 't': x.t || CASE WHEN x.t = '' THEN '' ELSE chr(10) END || 'user:' || text})) AS s2,
      least({'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t}, {'c': CASE WHEN gone OR c <> 'a' THEN 1000000000 ELSE s2.c + stay END, 'a': s2.a || 'K', 't': s2.t || chr(10) || role || ':' || text},
        {'c': CASE WHEN gone THEN 1000000000 ELSE s2.c + stay + 3 END, 'a': s2.a || 'R', 't': s2.t || chr(10) || 'assistant:' || text}) AS s3
    FROM v JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = v.i + 1))),
e AS (SELECT conv_id, least(s0, s3) AS best FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CASE WHEN n IS NULL THEN 0 ELSE best.c END::BIGINT AS cost, CASE WHEN n IS NULL THEN '' ELSE best.a END AS audit, sha256(CASE WHEN n IS NULL THEN '' ELSE best.t END) AS repaired_sha256
FROM e LEFT JOIN h ON e.conv_id IS NOT DISTINCT FROM h.conv_id
"""
