"""Repair of conversations against a search through all edits, and on awkward and long conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from panewise.llm import conversations as C

GRAMMAR, PREFIX = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")


def faults_of(rows):
    """(must go, truncated, fault) of each (turn, role, text)."""
    out, seen = [], set()
    for _, role, text in rows:
        stripped = text.strip(" \t\n\v\f\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def brute(rows):
    """The contract's numbers by going through all sequences of edits with at most two insertions in a row."""
    faults, best = faults_of(rows), []

    def go(i, roles, cost, audit, lines, inserted):
        if not PREFIX.fullmatch(roles):
            return
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, roles + role[0], cost + 3, audit + "I", [*lines, role + ":"], inserted + 1)
        if i == len(rows):
            if GRAMMAR.fullmatch(roles):
                best.append((cost, audit, "\n".join(lines)))
            return
        _, role, text = rows[i]
        go(i + 1, roles, cost + 4, audit + "D", lines, 0)
        if faults[i] not in ("blank", "duplicate"):
            more = cost + 3 * (faults[i] == "truncated")
            if role[:1] in ("s", "u", "a"):
                go(i + 1, roles + role[:1], more, audit + "K", [*lines, f"{role}:{text}"], 0)
            for to in ("user", "assistant"):
                go(i + 1, roles + to[0], more + 3, audit + "R", [*lines, f"{to}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    cost, audit, text = min(best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())


def found_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", *C.NUMBERS[:5], "cost", "audit", "repaired_sha256").collect()}


def test_repair_is_the_cheapest_edit(spark):
    rng, rows = random.Random(11), []
    for conv in [None, *range(90)]:
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, rng.choice(["Yes.", "No!", "cut off", "", " \n", None, "Same?"]), "extra"))
    found = found_of(C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest string")))
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = brute(sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x, _ in rows if c == conv), key=order))
    assert found == want


def test_damage_follows_the_contract(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"One. Two! Three? {t}") for c in range(30) for t in range(6)] + [(None, None, None, None), (500, 1, "user", "x.")]
    df, copies = C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {(r.conv_id, r.turn): (r.role, r.text, r.n) for r in df.withColumn("n", copies).collect()}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, 0 if kind == 0 else 2 if kind == 3 else 1)
        assert found[c, t] == want


def test_long_conversations_and_task_ends(spark):
    """Parts of a conversation over many tasks give what one search gives; a conversation without rows is known."""
    rng = random.Random(4)
    turns = lambda n: [(t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Fine.", f"Text {t}.", f"cut {t}", ""])) for t in range(n)]
    rows = {c: turns(n) for c, n in ((1, 3), (2, 2000), (3, 1), (4, 700), (5, 12), (7, 3000))}
    table = [(c, t, r, x, 1) for c, part in rows.items() for t, r, x in part] + [(6, 0, "user", "gone", 0), (7, 5, "user", "Again.", 40)]
    rows[7] = sorted([*rows[7], *[(5, "user", "Again.")] * 40], key=order)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, n long").repartition(5)
        found = found_of(C.repair(df, C.F.col("n")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    empty = hashlib.sha256(b"").hexdigest()
    assert found.pop(6) == (0, 0, 0, 0, 0, 0, "", empty)
    for c, part in rows.items():
        solver = C.Solver()
        solver.opened, solver.key, solver.whole = True, c, True
        layer, faults, replay = C.closed(C.first_layer(C.START)), faults_of(part), None
        for (_, role, text), fault in zip(part, faults):
            layer = C.step(layer, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit = C.cheapest(layer)
        replay = C.Replay(audit)
        for _, role, text in part:
            replay.turn(role, text)
        assert found[c][1:4] == (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"))
        assert found[c][5:] == (cost, audit, replay.digest())


def test_empty_table(spark):
    assert C.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
