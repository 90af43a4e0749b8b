"""Chat formatting with minimum-cost role repair.

A conversation is legal when an optional system message is followed by user and assistant messages
in turn, the last by the assistant. Dynamic programming over that automaton picks the cheapest
repair: merge a turn into the message before it, relabel it, or put empty messages before it.

A conversation need not fit one task. Turns are sorted and cut into segments by range; a segment's
least costs between any two states form a small matrix; matrices are chained (min-plus) for each
conversation, and every segment is repaired between the states that the chain picked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = ("", "system", "user", "assistant")
# Role names in use, by the role they stand for.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# The price of each repair; a role that is no known one is free to be named at UNKNOWN.
MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
FAR = 1 << 40


def role_state(role: str | None) -> int:
    """The state of a role name, START for one that is missing or unknown."""
    return ALIASES.get((role or "").strip().lower(), START)


def _paths() -> dict[int, dict[int, tuple[int, ...]]]:
    """For each state, the shortest run of empty messages to put in before a message of each role."""
    out: dict[int, dict[int, tuple[int, ...]]] = {}
    for s in STATES:
        best: dict[int, tuple[int, ...]] = {}
        queue: list[tuple[int, ...]] = [()]
        while queue:
            path = queue.pop(0)
            for r in LEGAL[path[-1] if path else s]:
                if r not in best:
                    best[r] = path
                    queue.append((*path, r))
        out[s] = best
    return out


PATHS = _paths()
#: Empty messages that end a conversation legally from each state; an empty conversation stays empty.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _moves() -> dict[int, dict[int, list[tuple[int, int, str, tuple[int, ...]]]]]:
    """moves[given][state]: (cost, next state, action, inserted before), the best for each next state."""
    out: dict[int, dict[int, list]] = {}
    for given, s in product(STATES, STATES):
        best: dict[int, tuple] = {}
        for r in (SYSTEM, USER, ASSISTANT):
            named = 0 if r == given else UNKNOWN if given == START else RELABEL
            plain = "keep" if not named else "relabel"
            if r in PATHS[s]:
                path = PATHS[s][r]
                best[r] = min(best.get(r, (FAR,)), (named + INSERT * len(path), r, plain, path))
            if r == s:
                best[r] = min(best.get(r, (FAR,)), (named + MERGE, r, "merge" if not named else "relabel+merge", ()))
        out.setdefault(given, {})[s] = [best[k] for k in sorted(best)]
    return out


MOVES = _moves()


def transfer(given: list[int]) -> list[list[int]]:
    """Least cost of a run of turns from each state to each."""
    rows = []
    for s in STATES:
        cost = [FAR] * 4
        cost[s] = 0
        for g in given:
            after = [FAR] * 4
            for state in STATES:
                if cost[state] < FAR:
                    for price, to, _, _ in MOVES[g][state]:
                        after[to] = min(after[to], cost[state] + price)
            cost = after
        rows.append(cost)
    return rows


def repair(given: list[int], entry: int, leave: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """The cheapest moves, one a turn, from entry to leave. Ties take the earlier action by name and the smaller states."""
    costs = [[FAR] * 4]
    costs[0][entry] = 0
    back: list[list] = []
    for g in given:
        after, came = [FAR] * 4, [None] * 4
        for state in STATES:
            if costs[-1][state] < FAR:
                for move in MOVES[g][state]:
                    total = costs[-1][state] + move[0]
                    if total < after[move[1]]:
                        after[move[1]], came[move[1]] = total, (state, move)
        costs.append(after)
        back.append(came)
    moves, state = [], leave
    for came in reversed(back):
        state, move = came[state]
        moves.append(move)
    return moves[::-1]


def _open(state: int) -> str:
    return f"<|{ROLES[state]}|>\n"


CLOSE = "<|end|>\n"


def pieces(texts: list[str], moves: list, entry: int, final: bool) -> list[str]:
    """What each turn adds to the rendered conversation; all pieces joined are the whole."""
    out, state = [], entry
    for text, (_, to, action, inserted) in zip(texts, moves):
        if "merge" in action:
            out.append("\n\n" + text)
        else:
            empty = "".join(_open(r) + CLOSE for r in inserted)
            out.append((CLOSE if state != START else "") + empty + _open(to) + text)
        state = to
    if final and out:
        out[-1] += CLOSE + "".join(_open(r) + CLOSE for r in ENDING[state])
    return out


_KEYS = ["no_conv", "conv", "segment"]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    names = (*_KEYS, "matrix")
    kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
    for group in runs(batches, _KEYS):
        matrix = transfer([role_state(r) for r in group["role"].to_pylist()])
        rows.append((*(group[k][0].as_py() for k in _KEYS), [x for row in matrix for x in row]))
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def chain(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, leave) states of each segment on the cheapest way from START to a legal end."""
    costs, back = [[0 if s == START else FAR for s in STATES]], []
    for m in matrices:
        after, came = [FAR] * 4, [START] * 4
        for s, to in product(STATES, STATES):
            if costs[-1][s] + m[4 * s + to] < after[to]:
                after[to], came[to] = costs[-1][s] + m[4 * s + to], s
        costs.append(after)
        back.append(came)
    state = min(STATES, key=lambda s: (costs[-1][s] + INSERT * len(ENDING[s]), -s))
    out = []
    for came in reversed(back):
        out.append((came[state], state))
        state = came[state]
    return out[::-1]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = (*_KEYS, "entry", "leave", "final")
    kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    for group in runs(batches, _KEYS[:2]):
        segments = group["segment"].to_pylist()
        states = chain(group["matrix"].to_pylist())
        n = len(segments)
        cols = [[group["no_conv"][0].as_py()] * n, [group["conv"][0].as_py()] * n, segments, [s for s, _ in states], [s for _, s in states], [k == n - 1 for k in range(n)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, _KEYS):
        given = [role_state(r) for r in group["role"].to_pylist()]
        entry, leave, final = (group[k][0].as_py() for k in ("entry", "leave", "final"))
        moves = repair(given, entry, leave)
        made = pieces([t or "" for t in group["text"].to_pylist()], moves, entry, final)
        last = len(moves) - 1
        ended = [[ROLES[r] for r in ENDING[leave]] if final and k == last else [] for k in range(len(moves))]
        cols = {
            "new_role": pa.array([ROLES[m[1]] for m in moves], pa.string()),
            "action": pa.array([m[2] for m in moves], pa.string()),
            "inserted_before": pa.array([[ROLES[r] for r in m[3]] for m in moves], pa.list_(pa.string())),
            "inserted_after": pa.array(ended, pa.list_(pa.string())),
            "cost": pa.array([m[0] + INSERT * len(e) for m, e in zip(moves, ended)], pa.int64()),
            "piece": pa.array(made, pa.string()),
        }
        for name, col in cols.items():
            group = group.append_column(name, col)
        yield from group.select(["no_conv", "conv", "segment", "turn", "role", *cols]).combine_chunks().to_batches()


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, new_role, action, inserted_before, inserted_after, cost, piece), one row a turn.

    Turns are ordered by turn, then role and text, nulls first; the pieces of a conversation in
    that order, joined, are its rendering. Roles are matched without case and outer blanks; a
    missing or unknown role may take any at a lower price. Null texts are empty, null
    conversation ids are one conversation, rows that repeat are turns of their own. An empty table
    gives no rows. Other columns are not read, so their names cannot clash.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col(conv_col).isNull().alias("no_conv"),
        F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    order = ["no_conv", "conv", "turn", "role", "text"]
    cut = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    cut = materialize(cut.withColumn("segment", F.spark_partition_id()), "turns")
    dealt = cut.repartition(*_KEYS).sortWithinPartitions("no_conv", "conv", "segment", "turn", "role", "text")
    matrices = dealt.mapInArrow(_matrices, "no_conv boolean, conv long, segment int, matrix array<long>")
    chains = matrices.repartition("no_conv", "conv").sortWithinPartitions(*_KEYS)
    chains = materialize(chains.mapInArrow(_chained, "no_conv boolean, conv long, segment int, entry int, leave int, final boolean"), "chains")
    joined = cut.join(chains, _KEYS).repartition(*_KEYS).sortWithinPartitions("no_conv", "conv", "segment", "turn", "role", "text")
    done = joined.mapInArrow(
        _repaired,
        "no_conv boolean, conv long, segment int, turn long, role string, new_role string, action string, "
        "inserted_before array<string>, inserted_after array<string>, cost long, piece string",
    )
    conv = F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")
    return done.select(conv, "turn", "role", "new_role", "action", "inserted_before", "inserted_after", "cost", "piece")
