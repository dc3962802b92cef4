"""Repair of conversation structure: cheapest edits to a legal order of roles, from a suffix-shared automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from riskgrid.operators.sizes import lookup_join
from riskgrid.sources.workdir import materialize

# Costs of the edits and of a truncated row that stays. Fixed values.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NULL = " "
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
# A conversation is handled in parts of so many turn numbers.
PART_TURNS = 512
NO_TURN = -(2 ** 62)
# Rows of evaluated signatures that are broadcast.
BROADCAST_SIGNATURES = 20_000

# The grammar (s?(ua)+)? over role initials. States: nothing yet, after s, after u, after a.
STATES = range(4)
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
# Role that an insertion or a change of role gives in each state.
NEXT = "uuau"
ROLE = {"u": "user", "a": "assistant"}
END = "end"
FAR = 10 ** 9


def damage(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with faults planted by crc32 of ``conversation:turn`` mod 20: ``conversation, turn, role, text, present``.

    0 drops the row (``present`` is false), 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it a
    user's. Nulls of role and text, and of the others in the hashed text, are one space.
    """
    def written(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(NULL))

    code = F.crc32(F.concat(written(conversation), F.lit(":"), written(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).cast("bigint").alias("turn"),
                        written(role).alias("role"), written(text).alias("text"), code.alias("code"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select(
        "conversation", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", STOPS, ""))
        .otherwise(F.col("text")).alias("text"), (F.col("code") != 0).alias("present"))


# -- the automaton --------------------------------------------------------------------------------

class Node:
    """Cost to go, best audit and leaving state for every grammar state, at one suffix of a signature."""

    __slots__ = ("cost", "audit", "out")

    def __init__(self, cost, audit, out):
        self.cost, self.audit, self.out = cost, audit, out


def end_node(exit: str) -> Node:
    """The node after the last row. ``end``: missing turns are inserted; else the costs of what follows."""
    if exit == END:
        return Node((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""), tuple(STATES))
    return Node(tuple(int(x) for x in exit.split(",")), ("",) * 4, tuple(STATES))


def longer(symbol: str, rest: Node) -> Node:
    """The node of a row in front of a suffix.

    ``symbol`` is d for a row that must go, else s, u, a or x (any other role), in capitals if truncated. Of the
    cheapest edits the one with the least letter is taken: every letter leads to one state, so its audit is the least.
    """
    low = symbol.lower()
    extra = TRUNCATED if low != symbol else 0
    best = []
    for state in STATES:
        options = [(DELETE + rest.cost[state], "D", state)]
        if low != "d":
            if low != "x" and STEP[low][state] is not None:
                options.append((KEEP + extra + rest.cost[STEP[low][state]], "K", STEP[low][state]))
            to = STEP[NEXT[state]][state]
            options.append((REROLE + extra + rest.cost[to], "R", to))
        best.append(min(options))
    # An insertion leads to another state at the same row; going on by two of them never pays.
    final: list = list(best)
    for state in (2, 3, 0, 1):
        to = STEP[NEXT[state]][state]
        final[state] = min(best[state], (INSERT + min(best[to], final[to])[0], "I", to))
    cost = tuple(x[0] for x in final)
    audit: list = [None] * 4
    out: list = [None] * 4

    def settle(state: int) -> None:
        if audit[state] is None:
            _, letter, to = final[state]
            if letter == "I":
                settle(to)
                audit[state], out[state] = "I" + audit[to], out[to]
            else:
                audit[state], out[state] = letter + rest.audit[to], rest.out[to]

    for state in STATES:
        settle(state)
    return Node(cost, tuple(audit), tuple(out))


def evaluate(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, Node, Node]]:
    """Signatures with what follows them, in the order of exit and reversed signature: their first nodes.

    Neighbours share the nodes of their common suffix, so every node is worked out once; only the path of the last
    signature is held.
    """
    path: list[Node] = []
    last_exit, last = None, ""
    for exit, signature in rows:
        backward = signature[::-1]
        if exit != last_exit:
            path, last = [end_node(exit)], ""
        shared = 0
        while shared < min(len(last), len(backward)) and last[shared] == backward[shared]:
            shared += 1
        del path[shared + 1:]
        for symbol in backward[shared:]:
            path.append(longer(symbol, path[-1]))
        last_exit, last = exit, backward
        yield exit, signature, path[-1], path[0]


def _evaluated(parts: DataFrame) -> DataFrame:
    """``exit, signature, cost, audit, out``: arrays by grammar state, one row per distinct signature."""
    distinct = parts.select("exit", "signature").distinct().withColumn("backward", F.reverse("signature"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list = []

        def rows():
            for batch in batches:
                yield from zip(batch["exit"], batch["signature"])

        def frame():
            return pd.DataFrame(waiting, columns=["exit", "signature", "cost", "audit", "out"])

        for exit, signature, node, end in evaluate(rows()):
            own = [c - (end.cost[o] if exit != END else 0) for c, o in zip(node.cost, node.out)]
            waiting.append((exit, signature, own, list(node.audit), list(node.out)))
            if len(waiting) >= 2000:
                yield frame()
                waiting = []
        if waiting:
            yield frame()

    return distinct.repartitionByRange("exit", "backward").sortWithinPartitions("exit", "backward").mapInPandas(
        run, "exit string, signature string, cost array<bigint>, audit array<string>, out array<int>")


def _edit_matrix(symbol: str) -> np.ndarray:
    low, extra = symbol.lower(), TRUNCATED if symbol.lower() != symbol else 0
    out = np.full((4, 4), FAR)
    for state in STATES:
        out[state, state] = DELETE
        if low != "d":
            to = STEP[NEXT[state]][state]
            out[state, to] = min(out[state, to], REROLE + extra)
            if low != "x" and STEP[low][state] is not None:
                to = STEP[low][state]
                out[state, to] = min(out[state, to], KEEP + extra)
    return out


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs over two steps."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _inserts() -> np.ndarray:
    once = np.where(np.eye(4) > 0, 0, FAR)
    for state in STATES:
        once[state, STEP[NEXT[state]][state]] = INSERT
    return _then(_then(once, once), once)


ROWS = {x: _then(_inserts(), _edit_matrix(x)) for x in "dsuaxSUAX"}


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def transfer(signatures: pd.Series) -> pd.Series:
    """Least cost of a signature from every grammar state to every other, row by row."""
    def one(signature: str) -> list[int]:
        total = np.where(np.eye(4) > 0, 0, FAR)
        for symbol in signature:
            total = _then(total, ROWS[symbol])
        return total.ravel().astype(int).tolist()

    return signatures.map(one)


def _with_exits(parts: DataFrame) -> DataFrame:
    """Add what follows every part: ``end``, or the costs to go at the start of the next part.

    Only conversations of several parts are gathered, as 16 numbers for each of their parts.
    """
    several = materialize(parts.groupBy("key").count().where("count > 1").select("key"), "several")
    matrices = lookup_join(parts, several, ["key"], "left_semi").select("key", "part", transfer("signature").alias("m"))

    def backward(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", ignore_index=True)
        follow = np.array(end_node(END).cost)
        exits = [END]
        for m in reversed(group["m"].tolist()[1:]):
            follow = np.minimum((np.asarray(m).reshape(4, 4) + follow).min(axis=1), FAR)
            follow = follow - follow.min()
            exits.append(",".join(map(str, follow)))
        return pd.DataFrame({"key": group["key"], "part": group["part"], "exit": exits[::-1]})

    exits = materialize(matrices.groupBy("key").applyInPandas(backward, "key string, part bigint, exit string"), "exits")
    return lookup_join(parts, exits, ["key", "part"]).withColumn("exit", F.coalesce("exit", F.lit(END)))


def _with_audits(parts: DataFrame) -> DataFrame:
    """Add ``cost``, ``audit`` and ``state`` (the grammar state before its first row) to every part."""
    known = materialize(_evaluated(parts), "signatures")
    joined = materialize(lookup_join(parts, known, ["exit", "signature"], max_rows=BROADCAST_SIGNATURES), "evaluated")

    def forward(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", ignore_index=True)
        states, state = [], 0
        for out in group["out"]:
            states.append(state)
            state = int(out[state])
        return pd.DataFrame({"key": group["key"], "part": group["part"], "state": states})

    several = joined.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    states = materialize(lookup_join(joined, several, ["key"], "left_semi").select("key", "part", "out").groupBy("key")
                         .applyInPandas(forward, "key string, part bigint, state int"), "states")
    placed = lookup_join(joined, states, ["key", "part"]).withColumn("state", F.coalesce("state", F.lit(0)))
    return placed.withColumns({"cost": F.get("cost", "state"), "audit": F.get("audit", "state")}).drop("out")


# -- rows -----------------------------------------------------------------------------------------

def _rows(turns: DataFrame) -> DataFrame:
    """Present rows with the keys that put them in order."""
    return turns.where("present").select(
        F.coalesce(F.col("conversation").cast("string"), F.lit(NULL)).alias("key"),
        F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(NO_TURN)).cast("bigint").alias("part"), "turn", "role",
        F.md5(F.col("text").cast("binary")).alias("digest"), "text")


def _parts(rows: DataFrame) -> DataFrame:
    """One row per part of a conversation: its signature, its counts and the initials at both ends."""
    shown = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "key", "part", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(*STOPS)).alias("cut"))
    order = Window.partitionBy("key", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    same = Window.partitionBy("key", "part", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    placed = materialize(narrow.withColumns({
        "place": F.row_number().over(order), "pair": F.concat(F.lag("initial").over(order), F.col("initial")),
        "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)),
        "again": F.row_number().over(same) > 1}), "placed")
    # Rows that an earlier part has: only conversations of several parts have any.
    spread = placed.where(~F.col("again")).groupBy("key", "role", "digest").agg(
        F.min("part").alias("first_part"), F.max("part").alias("last_part")).where("first_part < last_part")
    seen = lookup_join(placed, spread.drop("last_part"), ["key", "role", "digest"])
    duplicate = F.col("again") | F.coalesce(F.col("part") > F.col("first_part"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(duplicate, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("initial"))
              .otherwise(F.col("initial")))
    marked = seen.withColumn("fault", fault).withColumn("symbol", symbol)

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("bigint"))

    return marked.groupBy("key", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "")
        .alias("signature"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.coalesce(count(~F.col("pair").isin("su", "ua", "au")), F.lit(0)).alias("illegal"),
        count(F.col("new_turn")).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.min_by("initial", "place").alias("begins"), F.max_by("initial", "place").alias("ends"))


def _digests(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """SHA-256 of the repaired text of every conversation, ``key, sha``.

    A part's audit goes before its rows. Texts are shuffled once and hashed as they come; a task holds one batch.
    """
    texts = rows.select("key", "part", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    audits = parts.select("key", "part", F.lit(0).alias("kind"), F.col("state").cast("bigint").alias("turn"),
                          F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    ordered = (texts.unionByName(audits).repartition("key")
               .sortWithinPartitions("key", "part", "kind", F.col("turn").asc_nulls_first(), "role", "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, audit, at, written, sha = None, 0, "", 0, False, hashlib.sha256()

        def add(line: str) -> None:
            nonlocal written
            sha.update((("\n" if written else "") + line).encode())
            written = True

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                add(ROLE[NEXT[state]] + ":")
                state = STEP[NEXT[state]][state]
                at += 1

        for batch in batches:
            done: list = []
            for k, kind, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if k != key:
                    if key is not None:
                        inserts()
                        done.append((key, sha.hexdigest()))
                    key, audit, at, written, sha = k, "", 0, False, hashlib.sha256()
                if kind == 0:
                    inserts()
                    state, audit, at = turn, text, 0
                    continue
                inserts()
                letter = audit[at]
                at += 1
                if letter != "D":
                    initial = role[:1] if letter == "K" else NEXT[state]
                    add((role if letter == "K" else ROLE[initial]) + ":" + text)
                    state = STEP[initial][state]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["key", "sha"])
        if key is not None:
            inserts()
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "sha"])

    return ordered.select("key", "kind", "turn", "role", "text").mapInArrow(run, "key string, sha string")


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every conversation.

    Takes ``conversation, turn, role, text, present`` as :func:`damage` gives them. Rows are in the order of turn
    (nulls first), role and digest of the text. A row's first fault counts: blank, duplicate (its role and text
    stand in an earlier row), truncated. Edits: keep, change the role to user or assistant, delete (blank and
    duplicate rows must go), insert an empty user's or assistant's turn; ``audit`` holds the initials of the cheapest
    edits that make the roles ``(s?(ua)+)?``, of equally cheap ones the least.

    Signatures (a letter per row) of all conversations are reduced to distinct ones and laid out from their ends, so
    equal suffixes are one node; cost to go and best audit are worked out once per node and grammar state.
    A conversation of more than 512 turn numbers is handled in parts: each is a matrix of least costs, and 16 numbers
    a part are brought together. The repaired text is hashed in order, as SHA-256 allows no other way, by one
    task per conversation and without holding it; an audit is a string as long as its conversation has edits.

    Null conversations are one; conversations without a present row have zeros, an empty audit and the digest of an
    empty text. ``gaps`` are turn numbers that lack between the first and last, nulls apart. Null role and text are
    taken as one space. Repeated rows are duplicates. An empty table gives an empty result; other columns take no part.
    """
    clean = turns.withColumns({"role": F.coalesce("role", F.lit(NULL)), "text": F.coalesce("text", F.lit(NULL)),
                               "present": F.coalesce("present", F.lit(False)), "turn": F.col("turn").cast("bigint")})
    rows = _rows(clean)
    parts = materialize(_with_exits(materialize(_parts(rows), "parts")), "parts-exits")
    repaired = materialize(_with_audits(parts), "repaired")
    before = F.lag("ends").over(Window.partitionBy("key").orderBy("part"))
    across = F.concat(before, F.col("begins"))
    edges = repaired.withColumn("illegal", F.col("illegal") + F.coalesce(
        (~across.isin("su", "ua", "au")).cast("bigint"), F.lit(0)))
    sums = edges.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
        .alias("audit"))
    names = clean.groupBy(F.coalesce(F.col("conversation").cast("string"), F.lit(NULL)).alias("key")).agg(
        F.max("conversation").alias("conversation"))
    zero = F.lit(0).cast("bigint")
    return (names.join(sums, "key", "left").join(_digests(rows, repaired), "key", "left")
            .select("conversation", *[F.coalesce(c, zero).alias(c) for c in (
                "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
