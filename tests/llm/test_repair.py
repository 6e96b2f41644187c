"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from thermocline.llm import repair as R

DDL = "conv_id long, turn long, role string, text string, m string, digest int, kind string, edits long, first int"
TEXTS = ["Warm water.", "Where is it?", "cut off", "  ", "", None, "Gone! \n", "Yes.", "a" * 50_000 + ".", "no end " * 9_000]
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "s"]


def search(symbols):
    """Least (cost, audit) by Dijkstra over rows and states."""
    nxt, done, heap = (2, 2, 3, 2), {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done[i, s] = cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, nxt[s]))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s))
            if fault in (None, "truncated"):
                extra = 3 if fault else 0
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, initial))
                if kept:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept))
                heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, nxt[s]))
    return min(done[len(symbols), s] for s in (0, 3))


def damaged(rows):
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def slow(rows, hurt=True):
    every = {r[0] for r in rows}
    rows = list(damaged(rows)) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in every:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        symbols = [(r[2][:1], f) for r, f in zip(own, faults)]
        cost, audit = search(symbols)
        lines, state, at = [], 0, 0
        for e in audit:
            if e == "I":
                state = (2, 2, 3, 2)[state]
                lines.append({2: "user:", 3: "assistant:"}[state])
                continue
            _, _, role, text = own[at]
            at += 1
            if e != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[0]] if e == "K" else (2, 2, 3, 2)[state]
                lines.append(f"{role if e == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        turns = {r[1] for r in own} - {None}
        initials = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_up(seed=5):
    rng = random.Random(seed)
    rows = [(c, t * rng.randint(1, 2), rng.choice(ROLES), rng.choice(TEXTS)) for c in range(-3, 150) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "Who?") for t in range(3)] + [(700, None, "user", "Why?"), (700, None, "user", "Why?"), (700, None, "assistant", "So.")]
    rows += [(701, 2, "user", "Why?")] * 5  # repeated rows
    rows += [(800, t, ("user", "assistant")[t % 2] if t % 7 else "tool", f"Row {t % 400}.") for t in range(900)]
    return rows


def collected(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def test_block_tables_against_search():
    own, rng = R.tables(), random.Random(1)
    assert own.block_next.shape[1] == 9 ** R.BLOCK
    for _ in range(600):
        symbols = [rng.randrange(9) for _ in range(rng.randrange(14))]
        row = np.array(symbols, int)
        v, grown, _ = own.costs(row, own.end)
        made, state = own.trace(row, own.end, R.START)
        named = [("suat"[x // 2] if x < 8 else "u", "blank" if x == 8 else "truncated" if x % 2 else None) for x in symbols]
        assert (own.vectors[v][0] + grown, "".join(made) + R.closing(state)) == search(named)


@pytest.mark.parametrize("parts", [1, 13])
def test_repair_of_damaged_rows(spark, parts):
    """A conversation of 900 rows lies in several of 13 ranges; columns with names of the operator's own are ignored."""
    rows = made_up()
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], DDL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert collected(R.repair(R.damage(df), df)) == slow(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repair_without_damage(spark):
    rows = made_up(9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collected(R.repair(R.as_they_are(df), df)) == slow(rows, hurt=False)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damage(df), df).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(5, gone, "user", "Gone.")], df.schema)
    assert collected(R.repair(R.damage(only), only)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
