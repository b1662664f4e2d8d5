"""Chat formatting by minimum-cost role repair.

A legal conversation is [system] user assistant user ... and ends with a user or assistant
turn. Dynamic programming over the automaton of legal turns finds the cheapest repair of
each conversation (merging a turn into the one before, relabelling it, inserting an empty
turn), and the repaired sequence is rendered.

Conversations are cut into parts of a fixed range of turn numbers, and a part of too many
turns or bytes (equal turn numbers, long texts) is cut again by number, role and a hash of
the text, so none has to fit a task: each part first gives the cost between every entry and exit state, the parts of a
conversation are then joined by (min, +) products of these small tables, and each part is
repaired for the states it got.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

PART_TURNS = 4096
PART_BYTES = 4 << 20
GROUP_ROWS, GROUP_BYTES = 20_000, 16 << 20  # of the turns that a task takes at once, about
BROADCAST_ROWS = 100_000  # of four numbers each

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (USER, ASSISTANT)
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3  # costs; UNKNOWN: giving a role to a turn without a known one
NEVER = 1 << 40


def _inserts():
    """Cheapest empty turns that lead from each state to each other: {(s, t): turns}."""
    out = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (s, t), path in list(out.items()):
            for n in NEXT[t]:
                if (s, n) not in out or len(out[s, n]) > len(path) + 1:
                    out[s, n] = (*path, n)
    return out


INSERTS = _inserts()


def _moves():
    """For each state and given role: (cost, next state, inserted turns, merged) in the order
    in which equal costs are preferred."""
    out = {}
    for s in range(4):
        for role in (None, SYSTEM, USER, ASSISTANT):
            found = []
            for new in (SYSTEM, USER, ASSISTANT):
                change = 0 if new == role else UNKNOWN if role is None else RELABEL
                for via in range(4):
                    if (s, via) in INSERTS and new in NEXT[via]:
                        empty = INSERTS[s, via]
                        found.append((change + INSERT * len(empty), 0, new, empty, False))
                if new == s:
                    found.append((change + MERGE, 1, s, (), True))
            best = {}
            for move in sorted(found, key=lambda m: (m[0], m[1], len(m[3]), m[2])):
                best.setdefault(move[2], (move[0], *move[2:]))
            out[s, role] = sorted(best.values(), key=lambda m: (m[0], m[1]))
    return out


MOVES = _moves()


def costs(roles: list, entry: int) -> list[int]:
    """Cheapest cost from ``entry`` to each state over a sequence of roles."""
    now = [NEVER] * 4
    now[entry] = 0
    for role in roles:
        new = [NEVER] * 4
        for s in range(4):
            if now[s] < NEVER:
                for cost, to, _, _ in MOVES[s, role]:
                    if now[s] + cost < new[to]:
                        new[to] = now[s] + cost
        now = new
    return now


def repair(roles: list, entry: int, exit_: int) -> tuple[int, list[tuple[int, tuple, bool]]]:
    """(cost, [(role, turns inserted before, merged)]) of the cheapest repair that ends in
    state ``exit_``; ties go to the move that comes first in ``MOVES``, states in order."""
    now, back = [NEVER] * 4, []
    now[entry] = 0
    for role in roles:
        new, step = [NEVER] * 4, [None] * 4
        for s in range(4):
            if now[s] < NEVER:
                for cost, to, empty, merged in MOVES[s, role]:
                    if now[s] + cost < new[to]:
                        new[to], step[to] = now[s] + cost, (s, (to, empty, merged))
        now = new
        back.append(step)
    plan, state = [], exit_
    for step in reversed(back):
        state, done = step[state]
        plan.append(done)
    return now[exit_], plan[::-1]


def close(states: list[int]) -> tuple[int, int, tuple]:
    """(cost, last state, turns inserted at the end) of the cheapest legal end."""
    return min((states[s] + INSERT * len(INSERTS[s, e]), s, INSERTS[s, e]) for s in range(4) for e in ENDS if (s, e) in INSERTS)


def _role(value):
    return ROLES.get((value or "").strip().lower())


def _render(texts: list[str], plan, first: bool, tail: tuple) -> tuple[str, int]:
    out, n = [], 0

    def turn(role, text):
        nonlocal first, n
        out.append(("" if first else "\n") + f"<|{NAMES[role]}|>\n{text}")
        first = False
        n += 1

    for text, (role, empty, merged) in zip(texts, plan):
        for e in empty:
            turn(e, "")
        if merged:
            out.append("\n" + text)
        else:
            turn(role, text)
    for e in tail:
        turn(e, "")
    return "".join(out), n


KEY = ("part", "cut_turn", "cut_role", "piece")
KEYS = "part int, cut_turn long, cut_role string, piece int"
OUT = "part int, n_turns long, n_out long, cost long, n_merged long, n_relabelled long, n_inserted long, rendered string"


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per conversation and part, however long the conversation: conv_id, part (from
    0), n_turns in, n_out, the repair's cost and counts, rendered.

    A part holds the turns of ``part_turns`` consecutive numbers; one of more than
    ``part_turns`` turns or ``PART_BYTES`` has parts of its own for each turn number, role and
    range of text hashes. Turns are taken by number, then role (nulls first), then a hash of
    the text; a null turn number counts as the lowest. Role names ignore case and outer space; a null or unknown role may become
    any role at cost 1. A null text is empty. Repeated rows are turns like others. A turn
    without conv_id is a conversation of its own. The parts of a conversation, joined in
    order, are its rendering. Other columns are not read.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("part", F.greatest(F.lit(0), F.floor(F.coalesce("turn", F.lit(0)) / part_turns)).cast("int"))
    lone = rows.where(F.col("conv_id").isNull())
    rows = rows.where(F.col("conv_id").isNotNull())
    cells = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    cells = checkpointed(cells)
    n_rows, n_bytes = cells.agg(F.sum("n"), F.sum("bytes")).first()
    groups = max(1, (n_rows or 0) // GROUP_ROWS, (n_bytes or 0) // GROUP_BYTES)
    slices = F.ceil(F.greatest(F.col("n") / part_turns, F.col("bytes") / PART_BYTES))
    full = cells.select("conv_id", "part", slices.cast("int").alias("slices")).where("slices > 1")
    if full.count() <= BROADCAST_ROWS:
        full = F.broadcast(full)
    # a part that is cut has its turn, role and slice in its key, others have none
    cut = [F.when(F.col("slices").isNotNull(), F.col(c)).alias(f"cut_{c}") for c in ("turn", "role")]
    share = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
    piece = F.least(F.floor(share * F.col("slices")).cast("int"), F.col("slices") - 1).alias("piece")
    dealt = rows.join(full, ["conv_id", "part"], "left").select("conv_id", *KEY[:1], *cut, piece, "turn", "role", "text", F.xxhash64("text").alias("h"))
    task = F.pmod(F.xxhash64("conv_id", *KEY), F.lit(groups)).cast("int").alias("t")
    dealt = dealt.select("*", task)

    def ordered(key):
        """Sortable form of a part's key."""
        part, turn, role, piece = key
        return part, turn is not None, turn or 0, role is not None, role or "", piece or 0

    def keys_of(table):
        return list(zip(*(table.column(c).to_pylist() for c in KEY)))

    def parts_of(table):
        """(conv_id, part's key, role numbers, texts) of every part, turns in order."""
        conv, keys = table.column("conv_id").to_pylist(), keys_of(table)
        turn, role, text, h = (table.column(c).to_pylist() for c in ("turn", "role", "text", "h"))
        by = {}
        for k, name in enumerate(zip(conv, keys)):
            by.setdefault(name, []).append(k)
        for (c, key), at in by.items():
            at.sort(key=lambda k: (turn[k] is not None, turn[k] or 0, role[k] is not None, role[k] or "", h[k], text[k]))
            yield c, key, [_role(role[k]) for k in at], [text[k] for k in at]

    def keyed(conv, keys):
        cols = list(zip(*keys)) if keys else [()] * len(KEY)
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32())
        return {"conv_id": pa.array(conv, pa.int64())} | {n: pa.array(v, k) for n, v, k in zip(KEY, cols, kinds)}

    def tables(table):
        out = [(c, key, [x for s in range(4) for x in costs(roles, s)]) for c, key, roles, _ in parts_of(table)]
        c, key, m = zip(*out) if out else ((), (), ())
        return pa.table(keyed(c, key) | {"m": pa.array(m, pa.list_(pa.int64()))})

    def join_parts(table):
        """Number, entry and exit state of every part, and the turns that close the conversation."""
        out = []
        by = {}
        for c, key, m in zip(table.column("conv_id").to_pylist(), keys_of(table), table.column("m").to_pylist()):
            by.setdefault(c, []).append((key, m))
        for c, parts in by.items():
            parts.sort(key=lambda x: ordered(x[0]))
            now, back = [0, NEVER, NEVER, NEVER], []
            for _, m in parts:
                step = [min((now[s] + m[4 * s + e], s) for s in range(4)) for e in range(4)]
                now = [min(x[0], NEVER) for x in step]
                back.append([x[1] for x in step])
            _, state, tail = close(now)
            for k in range(len(parts) - 1, -1, -1):
                entry = back[k][state]
                out.append((c, parts[k][0], k, entry, state, list(tail) if k == len(parts) - 1 else []))
                state = entry
        conv, key, *cols = zip(*out) if out else [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        return pa.table(keyed(conv, key) | {n: pa.array(v, k) for n, v, k in zip(("number", "entry", "exit", "tail"), cols, kinds)})

    def finished(conv, part, roles, texts, entry, exit_, first, tail):
        cost, plan = repair(roles, entry, exit_)
        rendered, n_out = _render(texts, plan, first, tail)
        inserted = len(tail) + sum(len(e) for _, e, _ in plan)
        changed = sum(r != given for given, (r, _, _) in zip(roles, plan))
        merged = sum(m for _, _, m in plan)
        return conv, part, len(texts), n_out, cost + INSERT * len(tail), merged, changed, inserted, rendered

    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string())
    fields = ("conv_id", "part", "n_turns", "n_out", "cost", "n_merged", "n_relabelled", "n_inserted", "rendered")

    def as_table(out):
        cols = list(zip(*out)) if out else [()] * len(fields)
        return pa.table({n: pa.array(v, k) for n, v, k in zip(fields, cols, kinds)})

    def render(key, table, states):
        at = dict(zip(zip(states.column("conv_id").to_pylist(), keys_of(states)), states.to_pylist()))
        out = []
        for c, key, roles, texts in parts_of(table):
            s = at[c, key]
            out.append(finished(c, s["number"], roles, texts, s["entry"], s["exit"], s["number"] == 0, tuple(s["tail"])))
        return as_table(out)

    def alone(batches):
        for batch in batches:
            out = []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                roles = [_role(role)]
                _, state, tail = close(costs(roles, START))
                out.append(finished(None, 0, roles, [text], START, state, True, tail))
            yield from as_table(out).to_batches()

    first = dealt.groupBy("t").applyInArrow(tables, f"conv_id long, {KEYS}, m array<long>")
    few = first.withColumn("c", F.pmod(F.xxhash64("conv_id"), F.lit(groups)).cast("int"))
    states = few.groupBy("c").applyInArrow(
        lambda table: join_parts(table), f"conv_id long, {KEYS}, number int, entry int, exit int, tail array<int>"
    )
    states = states.select("*", task)
    done = dealt.groupBy("t").cogroup(states.groupBy("t")).applyInArrow(render, f"conv_id long, {OUT}")
    return done.unionByName(lone.mapInArrow(alone, f"conv_id long, {OUT}"))
