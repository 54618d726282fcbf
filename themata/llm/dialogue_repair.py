"""Repair of conversations by bidirectional Dijkstra search over the lattice of edits.

A conversation may open with one system turn; then user and assistant turns alternate, from a user
turn to an assistant turn. The lattice has a node for every number of turns consumed and every state of
that pattern. Its edges keep, rerole or delete the next turn, or insert an empty one. A search runs from
the start and one, backwards, from the accepting ends, each from its own heap; they meet, finish all
crossings of equal cost, and the least concatenated audit wins.

Turns are ordered by one range-partitioned sort and streamed. A conversation within one block of turns
is searched at once. One that is longer, or that two tasks share, is searched block by block, from every
state to every state; blocks are joined in rounds of a bounded number of blocks (costs add up, audits
concatenate), and the turns of each block are repaired where they are. So a conversation that holds a
large part of all turns is work for many tasks, and no task holds more than a few blocks of its texts.
Only what is as long as the conversation by its nature, its audit and the SHA-256 of its text, passes
through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themata.llm.common import column, slices
from themata.storage import materialise

# Costs of the edits, and of leaving a truncated turn.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ACCEPTED = (START, ASSISTANT)
FOLLOWS = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
LEGAL = ("su", "ua", "au")
BLANK = "\t\n\x0b\x0c\r "
#: Turns and characters of a block, and blocks that are joined at once.
BLOCK_TURNS, BLOCK_CHARS, JOINED_BLOCKS = 256, 4_000_000, 64
#: Conversations whose turns have the same marks are searched once; longer ones are not kept.
CACHED_MARKS, CACHED_SEARCHES = 48, 1 << 16
#: Leading characters of role and text that order turns between tasks.
ORDER_CHARS = 64

Found = tuple[int, str]

# --- search --------------------------------------------------------------------------------------
# A turn is one mark: the initial of its role (x for others), upper case if truncated, or d if it has to go.


def _inserts() -> list[tuple[int, str, int, int]]:
    return [(q, "I", INSERT, t) for (q, role), t in FOLLOWS.items() if role != "s"]


@lru_cache(maxsize=None)
def _turn_edges(mark: str) -> tuple[list, list]:
    """Edges (letter, cost, state) over a turn of this mark: by state before it and by state after it."""
    edges = [(q, "D", DELETE, q) for q in STATES]
    if mark != "d":
        extra = TRUNCATED if mark.isupper() else 0
        for (q, role), t in FOLLOWS.items():
            if role == mark.lower():
                edges.append((q, "K", extra, t))
            if role != "s":
                edges.append((q, "R", RENAME + extra, t))
    return _sides(edges)


def _sides(edges: list[tuple[int, str, int, int]]) -> tuple[list, list]:
    out, into = [[] for _ in STATES], [[] for _ in STATES]
    for q, letter, cost, t in edges:
        out[q].append((letter, cost, t))
        into[t].append((letter, cost, q))
    return out, into


INSERT_OUT, INSERT_INTO = _sides(_inserts())


def search(marks: str, start: int, ends: Iterable[int]) -> Found | None:
    """The least cost over the turns from state ``start`` to one of ``ends``, and the least such audit.

    Heaps are ordered by cost and then by turns consumed on that side, as keeping a turn may cost
    nothing: a node's labels of equal cost are then all there when it is settled, the least first. Two
    audits of the same turns and cost are never prefixes of each other, as insertions cost something,
    so a least audit is made of least parts.
    """
    n = len(marks)
    forward: dict[tuple[int, int], Found] = {}
    reverse: dict[tuple[int, int], Found] = {}
    ahead = [(0, 0, "", start)]
    behind = [(0, -n, "", q) for q in ends]
    best: Found | None = None

    def cross(left: Found | None, cost: int, letter: str, right: Found | None) -> None:
        nonlocal best
        if left is not None and right is not None:
            whole = left[0] + cost + right[0], left[1] + letter + right[1]
            if best is None or whole < best:
                best = whole

    while ahead or behind:
        first, last = (h[0][0] if h else 0 for h in (ahead, behind))
        if best is not None and first + last > best[0]:
            break
        if ahead and (not behind or first <= last):
            cost, at, audit, q = heappop(ahead)
            if (at, q) in forward:
                continue
            here = forward[at, q] = cost, audit
            cross(here, 0, "", reverse.get((at, q)))
            steps = [(at, edge) for edge in INSERT_OUT[q]]
            if at < n:
                steps += [(at + 1, edge) for edge in _turn_edges(marks[at])[0][q]]
            for place, (letter, price, t) in steps:
                cross(here, price, letter, reverse.get((place, t)))
                if (place, t) not in forward:
                    heappush(ahead, (cost + price, place, audit + letter, t))
        else:
            cost, at, audit, q = heappop(behind)
            at = -at
            if (at, q) in reverse:
                continue
            here = reverse[at, q] = cost, audit
            cross(forward.get((at, q)), 0, "", here)
            steps = [(at, edge) for edge in INSERT_INTO[q]]
            if at:
                steps += [(at - 1, edge) for edge in _turn_edges(marks[at - 1])[1][q]]
            for place, (letter, price, t) in steps:
                cross(forward.get((place, t)), price, letter, here)
                if (place, t) not in reverse:
                    heappush(behind, (cost + price, -place, letter + audit, t))
    return best


_cached_search = lru_cache(maxsize=CACHED_SEARCHES)(search)


def whole_search(marks: str) -> Found:
    """The cheapest repair of a whole conversation."""
    run = _cached_search if len(marks) <= CACHED_MARKS else search
    return run(marks, START, ACCEPTED)


def all_searches(marks: str) -> list[Found | None]:
    """The cheapest edits from every state to every state, by 4 x state before + state after."""
    run = _cached_search if len(marks) <= CACHED_MARKS else search
    return [run(marks, p, (q,)) for p in STATES for q in STATES]


def join_searches(left: list[Found | None], right: list[Found | None]) -> list[Found | None]:
    """The table of two runs of turns one after the other."""
    out: list[Found | None] = []
    for p in STATES:
        for q in STATES:
            pairs = ((left[4 * p + r], right[4 * r + q]) for r in STATES)
            sums = [(a[0] + b[0], a[1] + b[1]) for a, b in pairs if a and b]
            out.append(min(sums, default=None))
    return out


# --- turns ---------------------------------------------------------------------------------------


def marks_of(turns: list[tuple], seen: set) -> tuple[str, int, int, int]:
    """Marks of ``(turn, role, text)``, and how many are blank, repeated and truncated.

    ``seen`` holds digests or pairs that came earlier, and gets those of these turns.
    """
    out, counts = [], [0, 0, 0]
    for _, role, text in turns:
        end = text.rstrip(BLANK)
        if not end:
            fault = 0
        elif (role, text) in seen:
            fault = 1
        else:
            seen.add((role, text))
            fault = 2 if end[-1] not in ".!?" else 3
        if fault < 3:
            counts[fault] += 1
        mark = role[:1] if role[:1] in ("s", "u", "a") else "x"
        out.append("d" if fault < 2 else mark.upper() if fault == 2 else mark)
    return "".join(out), *counts


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def span(turns: list[tuple]) -> tuple[int | None, int | None, int]:
    """First and last turn number and the number of distinct ones, nulls aside."""
    numbers = [t[0] for t in turns if t[0] is not None]
    if not numbers:
        return None, None, 0
    return numbers[0], numbers[-1], 1 + sum(a != b for a, b in zip(numbers, numbers[1:], strict=False))


def step(state: int, letter: str, initial: str) -> int:
    """The state after an edit."""
    if letter == "D":
        return state
    if letter == "K":
        return FOLLOWS[state, initial]
    return ASSISTANT if state == USER else USER


def apply(turns: list[tuple], audit: str, state: int) -> list[tuple[str, str]]:
    """The repaired ``(role, text)`` of turns, by their part of the audit."""
    out, rest = [], iter(turns)
    for letter in audit:
        _, role, text = (None, "", "") if letter == "I" else next(rest)
        state = step(state, letter, role[:1])
        if letter != "D":
            out.append((role if letter == "K" else ("user" if state == USER else "assistant"), text))
    return out


# --- Spark ---------------------------------------------------------------------------------------

TURNS = "array<struct<turn: bigint, role: string, text: string>>"
REPAIRED = "array<struct<role: string, text: string>>"
TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURN_TYPE = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_DONE_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIRST = pa.schema(
    [("conv_id", pa.int64()), ("whole", pa.bool_()), ("task", pa.int32()), ("no", pa.int64())]
    + [(n, pa.int64()) for n in TOTALS]
    + [("edits", pa.string()), ("repaired", _DONE_TYPE), ("turns", _TURN_TYPE)]
)
_FIRST_SQL = (
    "conv_id bigint, whole boolean, task int, no bigint, "
    + ", ".join(f"{n} bigint" for n in TOTALS)
    + f", edits string, repaired {REPAIRED}, turns {TURNS}"
)


def _batches(rows: Iterable[tuple], schema: pa.Schema, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size as a last value, as batches of bounded size."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    for *row, weight in rows:
        if held and (len(held) >= 4096 or size + weight > chars):
            yield batch()
            held, size = [], 0
        held.append(tuple(row))
        size += weight
    if held:
        yield batch()


def _whole(conv, turns: list[tuple], chars: int) -> tuple:
    marks, *faults = marks_of(turns, set())
    cost, audit = whole_search(marks)
    low, high, distinct = span(turns)
    gaps = high - low + 1 - distinct if distinct else 0
    illegal = illegal_pairs([t[1] for t in turns])
    return (conv, True, 0, 0, gaps, *faults, illegal, cost, audit, apply(turns, audit, START), None, chars)


def _first_pass(block_turns: int, block_chars: int):
    """Whole conversations repaired, others cut into blocks, from sorted turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            conv: object = None
            begun = cut = False
            held: list[tuple] = []
            chars = no = 0

            def block() -> tuple:
                return (conv, False, task, no, *[None] * 8, held, chars)

            for batch in slices(batches, "text"):
                names = ("conv_id", "turn", "role", "text", "gone")
                for c, turn, role, text, gone in zip(*(column(batch, n) for n in names), strict=True):
                    if not begun:
                        # The task before this one may hold the first turns of its first conversation.
                        conv, begun, cut = c, True, True
                    elif c != conv:
                        yield block() if cut else _whole(conv, held, chars)
                        no += cut
                        conv, cut, held, chars = c, False, [], 0
                    if gone:
                        continue
                    if held and (len(held) >= block_turns or chars + len(text) > block_chars):
                        yield block()
                        no, cut, held, chars = no + 1, True, [], 0
                    held.append((turn, role, text))
                    chars += len(text) + len(role)
            if begun:
                # The next task may hold more of the last conversation.
                yield block()

        yield from _batches(rows(), _FIRST)

    return run


def _digest(turn: Column) -> Column:
    role = turn["role"]
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, turn["text"]), 256)


_BLOCK = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("no", pa.int64()), ("idx", pa.int64())]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "low", "high", "distinct")]
    + [("marks", pa.string()), ("ends", pa.list_(pa.string()))]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("turns", _TURN_TYPE)]
)
_BLOCK_SQL = (
    "conv_id bigint, task int, no bigint, idx bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, low bigint, high bigint, distinct bigint, marks string, ends array<string>, "
    f"costs array<bigint>, audits array<string>, turns {TURNS}"
)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults and the table of searches of every block."""

    def rows() -> Iterator[tuple]:
        names = ("conv_id", "task", "no", "idx", "turns", "digests", "earlier")
        for batch in batches:
            for at in range(batch.num_rows):
                conv, task, no, idx, turns, digests, earlier = (
                    column(batch.slice(at, 1), n)[0] for n in names
                )
                turns = [(t["turn"], t["role"], t["text"]) for t in turns or []]
                known = set(earlier or ())
                repeated = {(r, x) for (_, r, x), d in zip(turns, digests or (), strict=True) if d in known}
                marks, *faults = marks_of(turns, repeated)
                found = all_searches(marks)
                roles = [t[1] for t in turns]
                yield (
                    conv, task, no, idx, *faults, illegal_pairs(roles), *span(turns), marks,
                    [roles[0][:1], roles[-1][:1]] if roles else None,
                    [f[0] if f else -1 for f in found], [f[1] if f else "" for f in found], turns,
                    sum(len(t[2]) for t in turns),
                )

    yield from _batches(rows(), _BLOCK)


def _join_blocks(table: pa.Table, idx: int) -> pa.Table:
    """One row, number ``idx``, for a bounded run of blocks of a conversation."""
    whole = None
    for row in sorted(table.to_pylist(), key=lambda r: r["idx"]):
        found = [(c, a) if c >= 0 else None for c, a in zip(row["costs"], row["audits"], strict=True)]
        whole = found if whole is None else join_searches(whole, found)
    return pa.table(
        {
            "conv_id": pa.array([table.column("conv_id")[0].as_py()], pa.int64()),
            "idx": pa.array([idx], pa.int64()),
            "costs": pa.array([[f[0] if f else -1 for f in whole]], pa.list_(pa.int64())),
            "audits": pa.array([[f[1] if f else "" for f in whole]], pa.list_(pa.string())),
        }
    )


_PART = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("no", pa.int64()), ("idx", pa.int64())]
    + [(n, pa.int64()) for n in TOTALS]
    + [("blocks", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]
)
_PART_SQL = (
    "conv_id bigint, task int, no bigint, idx bigint, "
    + ", ".join(f"{n} bigint" for n in TOTALS)
    + ", blocks bigint, state int, edits string"
)


def _cut_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's part of the audit and state before it, and a row of totals per conversation.

    The rows of a conversation follow each other: its audit first, then its blocks without texts.
    """

    def rows() -> Iterator[tuple]:
        open_row = None
        names = [
            "conv_id", "task", "no", "idx", "blank", "duplicate", "truncated", "illegal", "low", "high",
            "distinct", "marks", "ends", "cost", "audit",
        ]

        def totals() -> tuple:
            gaps = t["high"] - t["low"] + 1 - t["distinct"] if t["distinct"] else 0
            sums = [t[n] for n in TOTALS[1:]]
            return (open_row["conv_id"], None, None, None, gaps, *sums, t["blocks"], None, None, 0)

        for batch in batches:
            for values in zip(*(column(batch, n) for n in names), strict=True):
                row = dict(zip(names, values, strict=True))
                if row["idx"] < 0:
                    if open_row is not None:
                        yield totals()
                    open_row, at, state, last = row, 0, START, None
                    t = {n: 0 for n in (*TOTALS, "low", "high", "distinct", "blocks")}
                    t["cost"], t["low"], before = row["cost"], None, None
                    continue
                audit, begin, before_state = open_row["audit"], at, state
                for mark in row["marks"]:
                    while audit[at] == "I":
                        state, at = step(state, "I", ""), at + 1
                    state, at = step(state, audit[at], mark.lower()), at + 1
                while at < len(audit) and audit[at] == "I":
                    state, at = step(state, "I", ""), at + 1
                for n in ("blank", "duplicate", "truncated", "illegal", "distinct"):
                    t[n] += row[n]
                t["blocks"] += 1
                if row["ends"]:
                    if last is not None:
                        t["illegal"] += last + row["ends"][0] not in LEGAL
                    last = row["ends"][1]
                if row["distinct"]:
                    t["distinct"] -= before == row["low"]
                    t["low"] = row["low"] if t["low"] is None else t["low"]
                    t["high"] = before = row["high"]
                yield (
                    row["conv_id"], row["task"], row["no"], row["idx"], *[None] * 7, before_state,
                    audit[begin:at], at - begin,
                )
        if open_row is not None:
            yield totals()

    yield from _batches(rows(), _PART)


def _repair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("task", pa.int32()), ("no", pa.int64()), ("repaired", _DONE_TYPE)])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                turns = [(t["turn"], t["role"], t["text"]) for t in column(one, "turns")[0] or []]
                done = apply(turns, column(one, "edits")[0], column(one, "state")[0])
                key = column(one, "task")[0], column(one, "no")[0]
                yield (*key, done, sum(len(x) for _, x in done))

    yield from _batches(rows(), schema)


def _repair_long(cut: DataFrame, joined_blocks: int) -> DataFrame:
    """The blocks of cut conversations, repaired."""
    # A block has one key, (task, no), and a number in its conversation. Only keys meet in the window.
    order = Window.partitionBy("conv_id").orderBy("task", "no")
    numbers = cut.select("task", "no", (F.row_number().over(order) - 1).cast("long").alias("idx"))
    digests = F.transform("turns", _digest).alias("digests")
    blocks = cut.select("conv_id", "task", "no", "turns", digests)
    # A turn is a repeat if an earlier block has it; within its block it is found there. A block
    # sends each of its distinct turns once.
    here = F.struct("task", "no")
    said = blocks.select("conv_id", "task", "no", F.explode(F.array_distinct("digests")).alias("d"))
    first = F.min(here).over(Window.partitionBy("conv_id", "d"))
    earlier = (
        said.withColumn("first", first)
        .where(here > F.col("first"))
        .groupBy("task", "no")
        .agg(F.collect_list("d").alias("earlier"))
    )
    keyed = blocks.join(numbers, ["task", "no"]).join(earlier, ["task", "no"], "left")
    searched = materialise(keyed.mapInArrow(_search_blocks, _BLOCK_SQL), "edit-blocks")

    joined = searched.select("conv_id", "idx", "costs", "audits")
    while True:
        joined = materialise(
            joined.withColumn("run", F.floor(F.col("idx") / joined_blocks))
            .groupBy("conv_id", "run")
            .applyInArrow(
                lambda key, table: _join_blocks(table, key[1].as_py()),
                "conv_id bigint, idx bigint, costs array<bigint>, audits array<string>",
            ),
            "edit-runs",
        )
        if not joined.agg(F.max("idx")).first()[0]:
            break
    ends = F.transform(
        F.array(*[F.lit(START * 4 + q + 1) for q in ACCEPTED]),
        lambda at: F.struct(
            F.element_at("costs", at).alias("cost"), F.element_at("audits", at).alias("audit")
        ),
    )
    best = F.array_min(F.filter(ends, lambda e: e["cost"] >= 0))
    audits = joined.select("conv_id", F.lit(-1).cast("long").alias("idx"), best.alias("b")).select(
        "conv_id", "idx", "b.cost", "b.audit"
    )
    light = searched.drop("turns", "costs", "audits")
    parts = materialise(
        light.unionByName(audits, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "idx")
        .mapInArrow(_cut_audits, _PART_SQL),
        "edit-parts",
    )
    slices_ = parts.where("task IS NOT NULL").select("conv_id", "task", "no", "idx", "state", "edits")
    totals = parts.where("task IS NULL").select(F.col("conv_id").alias("of"), *TOTALS, "blocks")
    done = (
        searched.select("task", "no", "turns")
        .join(slices_.select("task", "no", "state", "edits"), ["task", "no"])
        .mapInArrow(_repair_blocks, f"task int, no bigint, repaired {REPAIRED}")
    )
    return (
        slices_.join(done, ["task", "no"])
        .join(totals, F.col("conv_id").eqNullSafe(F.col("of")))
        .select("conv_id", F.col("idx").alias("block"), "blocks", *TOTALS, "edits", "repaired")
    )


def repair(
    turns: DataFrame,
    block_turns: int = BLOCK_TURNS,
    block_chars: int = BLOCK_CHARS,
    joined_blocks: int = JOINED_BLOCKS,
) -> DataFrame:
    """Repair conversations given as ``(conv_id, turn, role, text)``, optionally ``gone``.

    Returns ``(conv_id, block, blocks, gaps, blank, duplicate, truncated, illegal, cost, edits,
    repaired)``: one row for a conversation, or several, ``block`` 0, 1, ..., for one that was cut. The
    counts and the cost are those of the conversation, ``edits`` (initials of Keep, Rerole, Delete,
    Insert) and ``repaired`` (role and text of turns) those of the block.

    Turns are ordered by turn, nulls first, then by role and text. Null role or text is one space.
    Rows with a null conv_id are one conversation. Rows that are ``gone`` count as dropped: their
    conversation stays, if need be without turns. Repeated rows are duplicates, except the first.
    Other columns are ignored, and an empty table gives no rows.
    """
    space = F.lit(" ")
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        gone.alias("gone"),
    )
    said = F.concat("role", F.lit("\0"), "text")
    ordered = (
        rows.repartitionByRange("conv_id", "turn", F.substring(said, 1, ORDER_CHARS))
        .sortWithinPartitions("conv_id", "turn", said)
        .mapInArrow(_first_pass(block_turns, block_chars), _FIRST_SQL)
    )
    found = materialise(ordered, "edits")
    whole = found.where("whole").select(
        "conv_id", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"), *TOTALS,
        "edits", "repaired",
    )
    long = _repair_long(found.where("NOT whole").select("conv_id", "task", "no", "turns"), joined_blocks)
    return whole.unionByName(long)


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of conversations of several blocks, which follow each other."""
    names = ("conv_id", "block", "blocks", *TOTALS, "edits", "repaired")
    schema = pa.schema(
        [("conv_id", pa.int64())] + [(n, pa.int64()) for n in TOTALS]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(batch.num_rows):
                conv, block, blocks, *totals, edits, repaired = (
                    column(batch.slice(at, 1), n)[0] for n in names
                )
                if block == 0:
                    audit, hashed, begun = [], hashlib.sha256(), False
                audit.append(edits)
                for turn in repaired or []:
                    hashed.update(f"{chr(10) * begun}{turn['role']}:{turn['text']}".encode())
                    begun = True
                if block == blocks - 1:
                    yield (conv, *totals, "".join(audit), hashed.hexdigest(), 128)

    yield from _batches(rows(), schema)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, the whole audit and the SHA-256 of the repaired turns."""
    columns = ["conv_id", *TOTALS]
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    hashed = F.sha2(F.concat_ws("\n", lines), 256).alias("repaired_sha256")
    short = repaired.where("blocks = 1").select(*columns, F.col("edits").alias("audit"), hashed)
    schema = "conv_id bigint, " + ", ".join(f"{n} bigint" for n in TOTALS)
    long = (
        repaired.where("blocks > 1")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "block")
        .mapInArrow(_hash_blocks, f"{schema}, audit string, repaired_sha256 string")
    )
    return short.unionByName(long)


def damage(turns: DataFrame) -> DataFrame:
    """Damage turns by the crc32 of ``conv_id:turn``; dropped ones stay as rows that are ``gone``.

    Of 20 remainders, 0 drops the turn, 1 empties its text, 2 takes out ``. ! ?``, 3 repeats the turn
    and 4 makes it the user's. Nulls count as one space.
    """
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(n).cast("string"), space) for n in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
