"""Conversation repair against a plain search over all edits of single conversations."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from riskgrid.llm import repair
from riskgrid.llm.queries import all_queries

AFTER = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def cheapest(rows, faults):
    """Least cost, then least audit, over all edits: a search that goes on from the cheapest."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if (i, last, audit) in done:
            continue
        done.add((i, last, audit))

        def go(extra, letter, j, initial, line):
            if line is None or (last, initial) in AFTER:
                heapq.heappush(heap, (cost + extra, audit + letter, j, initial, lines + (() if line is None else (line,))))

        for role in ("user", "assistant"):
            go(2, "I", i, role[0], f"{role}:")
        if i < len(rows):
            _, role, text = rows[i]
            go(3, "D", i + 1, last, None)
            if faults[i] not in ("blank", "duplicate"):
                extra = 1 if faults[i] == "truncated" else 0
                go(extra, "K", i + 1, role[:1], f"{role}:{text}")
                for other in ("user", "assistant"):
                    go(2 + extra, "R", i + 1, other[0], f"{other}:{text}")


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen
                      else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, (
        "blank", "duplicate", "truncated")), illegal, *cheapest(rows, faults))


def repaired(df):
    return {r["conversation"]: tuple(r)[1:] for r in repair.repair(df).collect()}


def present(spark, rows):
    return spark.createDataFrame([(*r, True) for r in rows],
                                 "conversation bigint, turn bigint, role string, text string, present boolean")


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                             "repaired_sha256"))
           for r in all_queries()["op13_repaired_conversations"](spark, folder).collect()}
    assert got == {c: plain(r) for c, r in damaged(rows).items()}


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            text = rng.choice(["", " \n", f"t{turn}.", f"t{turn} ", "same!", f"é{turn}?\t"])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "tool", ""]),
                         text))
    return rows


@pytest.mark.parametrize("part_turns", [2, 512])
def test_random_conversations(spark, monkeypatch, part_turns):
    """With parts of two turn numbers most conversations have several, whose borders must not show."""
    monkeypatch.setattr(repair, "PART_TURNS", part_turns)
    rows = conversations(part_turns, 60, 7)
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    assert repaired(present(spark, rows)) == {c: plain(r) for c, r in by.items()}


def test_long_conversation(spark):
    rows = [(1, t, "user" if t % 3 else "system", f"text {t % 700}.") for t in range(3000)]
    rows += [(2, t, "ua"[t % 2], "x.") for t in range(2)]
    got = repaired(present(spark, rows))
    assert got[1][:5] == (0, 0, 3000 - 700 * 2, 0, sum(
        "su ua au".find((("user", "system")[t % 3 == 0])[0] + ("user", "system")[(t + 1) % 3 == 0][0]) < 0
        for t in range(2999)))
    backward = repair.end_node(repair.END)
    seen, signature = set(), ""
    for _, _, role, text in rows[:3000]:
        signature += "d" if (role, text) in seen else role[0]
        seen.add((role, text))
    for symbol in reversed(signature):
        backward = repair.longer(symbol, backward)
    assert got[1][5:7] == (backward.cost[0], backward.audit[0])


def test_all_short_signatures():
    """Every signature of up to four rows: the automaton's first state equals the plain search."""
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for n in range(5):
        letters = itertools.product("dsuaxSUAX"[:9 if n < 4 else 5], repeat=n)
        keys = sorted(((repair.END, "".join(x)) for x in letters), key=lambda k: k[1][::-1])
        for _, signature, node, _ in repair.evaluate(iter(keys)):
            rows = [(i, roles.get(x.lower(), "user"), str(i)) for i, x in enumerate(signature)]
            faults = ["blank" if x == "d" else "truncated" if x.isupper() else "" for x in signature]
            assert (node.cost[0], node.audit[0]) == cheapest(rows, faults)[:2], signature


def test_suffixes_are_shared(monkeypatch):
    calls = []
    longer = repair.longer
    monkeypatch.setattr(repair, "longer", lambda s, n: (calls.append(s), longer(s, n))[1])
    keys = sorted(["uaua", "sua", "ua", "xua", "uaux"], key=lambda x: x[::-1])
    assert len(list(repair.evaluate((repair.END, k) for k in keys))) == 5
    assert len(calls) == len({k[i:] for k in keys for i in range(len(k))})


def test_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, row int, key int, part int, audit int"
    rows = [(None, None, None, None), (None, 1, "user", "x."), (None, 1, "user", "x."), (1, None, "user", None),
            (2, 0, None, "a"), (2, 0, "assistant", "long " * 50_000), (3, 5, "user", ""), (3, 2 ** 40, "assistant", "b."),
            (4, -7, "user", "c?"), (4, -3, "assistant", "d!\x0b"), (4, -3, "assistant", "d! ")]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], schema)
    got = repaired(repair.damage(df, "conv_id", "turn", "role", "text"))
    assert got == {c: plain(r) for c, r in damaged(rows).items()}
    empty = repair.repair(repair.damage(df.limit(0), "conv_id", "turn", "role", "text"))
    assert empty.collect() == []


def test_dropped_rows_leave_their_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "x.")], "conv_id bigint, turn bigint, role string, text string")
    got = repaired(repair.damage(df, "conv_id", "turn", "role", "text"))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
