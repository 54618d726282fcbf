"""A prefix trie of conversations, in double arrays of bounded size.

A turn is 120 bits of the MD5 of its role and text. A node, the sequence of the first d turns of a
conversation, is two sums of mixed turn hashes and depths, so a path may be cut anywhere and every part
still names its nodes. Paths are cut into segments of a bounded number of turns; segments of equal nodes
are counted as one before they move. Sorted by path, they are packed into blocks: one start node, a
bounded number of turns, dense ids for the turns of the block, and BASE and CHECK arrays. The child of
slot s by turn id t is slot BASE[s] + t if CHECK of that is s.

Blocks are traversed for their nodes. Nodes that several blocks share (the upper ones, and all that
groups of copies cross) are merged globally by key. Subtree sums then go up within each block, where
the block that holds a node's smallest member counts the node, and are merged again; what long
conversations hold below a segment is added to the segment's last node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themata.functions.draws import _mix as mix
from themata.storage import materialise

#: Turns of a segment, turns of a block, and turns that order segments between tasks.
SEGMENT_TURNS, BLOCK_TURNS, ORDER_TURNS = 512, 1 << 15, 8
#: Leading characters of role and text that order turns of equal number.
ORDER_CHARS = 64
#: Most turns that a conversation takes over, and the conversations that share a beginning.
MOST_TAKEN, SHARED = 8, 5
#: Slots tried for a node's children before they go to the end of the arrays.
TRIES = 64

_LONGS = pa.list_(pa.int64())


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", _LONGS: "array<bigint>", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# --- double arrays -------------------------------------------------------------------------------


class DoubleArray:
    """A trie of sorted sequences of ids from 1 on, as BASE and CHECK arrays; slot 0 is the root."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.base, self.check = [0], [0]
        self.free = 1
        # Runs of sequences that agree up to a node: (slot, depth, first, last).
        open_runs = [(0, 0, 0, len(sequences))]
        while open_runs:
            slot, depth, first, last = open_runs.pop()
            while first < last and len(sequences[first]) == depth:
                first += 1
            children: list[tuple[int, int, int]] = []
            at = first
            while at < last:
                turn, begin = sequences[at][depth], at
                while at < last and sequences[at][depth] == turn:
                    at += 1
                children.append((turn, begin, at))
            if not children:
                continue
            base = self._place([c[0] for c in children])
            self.base[slot] = base
            for turn, begin, end in children:
                self.check[base + turn] = slot
                open_runs.append((base + turn, depth + 1, begin, end))

    def _grow(self, size: int) -> None:
        missing = size - len(self.check)
        if missing > 0:
            self.base += [-1] * missing
            self.check += [-1] * missing

    def _place(self, turns: list[int]) -> int:
        """A base whose slots for these ids are free."""
        check = self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        at = max(self.free, turns[0])
        for _ in range(TRIES):
            base = at - turns[0]
            if all(base + t >= len(check) or check[base + t] < 0 for t in turns):
                break
            at += 1
        else:
            base = len(check)
        self._grow(base + turns[-1] + 1)
        return base

    def child(self, slot: int, turn: int) -> int:
        """The slot of a child, or -1."""
        base = self.base[slot]
        at = base + turn
        return at if base >= 0 and 0 < at < len(self.check) and self.check[at] == slot else -1


# --- keys ----------------------------------------------------------------------------------------


def turn_terms(d1: np.ndarray, d2: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What turns after ``depth`` others add to the two halves of a node's key."""
    place = np.arange(depth + 1, depth + 1 + len(d1), dtype=np.uint64)
    one = mix(d1.astype(np.uint64) ^ mix(place))
    return one, mix(d2.astype(np.uint64) ^ mix(~place))


def _signed(value) -> int:
    return int(np.uint64(value).view(np.int64))


def _running(start: int, terms: np.ndarray) -> list[int]:
    """A half of the keys of a path: its start and the sums after each turn."""
    first = np.asarray([start], np.int64).view(np.uint64)
    return np.concatenate([first, terms]).cumsum(dtype=np.uint64).view(np.int64).tolist()


# --- paths ---------------------------------------------------------------------------------------

_RUN = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("at", pa.int64()), ("d1", _LONGS), ("d2", _LONGS), ("nb", _LONGS)]
)


def ordered_turns(turns: DataFrame, segment: int) -> DataFrame:
    """Runs of turns, ``(conv_id, at, d1, d2, nb)``: their place, hashes and bytes of text.

    The sort is partitioned by range, so that a conversation may spread over many tasks.
    """
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))

    def half(first: int) -> Column:
        return F.conv(F.substring(digest, first, 15), 16, 10).cast("long")

    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.concat(role, F.lit("\0"), text), 1, ORDER_CHARS).alias("lead"),
        half(1).alias("d1"),
        half(16).alias("d2"),
        F.octet_length(text).cast("long").alias("nb"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def runs() -> Iterator[tuple]:
            conv, at, held = None, 0, []
            for batch in batches:
                columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "d1", "d2", "nb"))
                for c, *turn in zip(*columns, strict=True):
                    if held and (c != conv or len(held) == segment):
                        yield (conv, task, at, *map(list, zip(*held, strict=True)))
                        at, held = at + len(held), []
                    if c != conv:
                        conv, at = c, 0
                    held.append(turn)
            if held:
                yield (conv, task, at, *map(list, zip(*held, strict=True)))

        yield from _batches(runs(), _RUN)

    order = ["conv_id", "turn", "lead", "d1", "d2"]
    runs = materialise(
        rows.repartitionByRange("conv_id", "turn", "lead", "d1")
        .sortWithinPartitions(*order)
        .mapInArrow(cut, _sql(_RUN)),
        "turn-runs",
    )
    # Turns of a conversation in earlier tasks. A task has one such conversation at most, its first.
    sizes = runs.groupBy("conv_id", "task").agg(F.sum(F.size("d1")).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("conv_id", "task", F.sum("n").over(before).alias("base")).where("base > 0")
    placed = runs.join(F.broadcast(bases), ["conv_id", "task"], "left")
    at = (F.coalesce("base", F.lit(0)) + F.col("at")).alias("at")
    return placed.select("conv_id", at, "d1", "d2", "nb")


def _from(first: Column) -> list[Column]:
    """The arrays of a run from a place on."""
    n = F.greatest(F.size("d1") - first, F.lit(0))
    return [F.slice(c, (first + 1).cast("int"), n.cast("int")).alias(c) for c in ("d1", "d2", "nb")]


def rebuilt_paths(turns: DataFrame, segment: int = SEGMENT_TURNS) -> DataFrame:
    """Segments of the rebuilt conversations: ``(conv_id, depth, d1, d2, nb)``, ``depth`` turns before them.

    Conversation c takes over the first h turns of conversation c - c % 5, with h the crc32 of its id
    modulo 9, and goes on with its own turns after its first h.
    """
    runs = materialise(ordered_turns(turns, segment), "turns")
    conv = F.col("conv_id")
    taken = (F.crc32(conv.cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("long")
    convs = runs.select("conv_id").distinct().select(
        "conv_id", taken.alias("h"), (conv - conv % SHARED).alias("of")
    )
    # The first turns, eight at most, of those that others begin like.
    zipped = F.arrays_zip("d1", "d2", "nb")
    few = F.slice(zipped, 1, MOST_TAKEN)
    firsts = (
        runs.where((conv % SHARED == 0) & (F.col("at") < MOST_TAKEN))
        .select(conv.alias("of"), F.posexplode(few).alias("i", "t"), "at")
        .select("of", (F.col("at") + F.col("i")).alias("at"), "t")
        .where(F.col("at") < MOST_TAKEN)
        .groupBy("of")
        .agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("first"))
    )
    head = F.coalesce(F.slice("first", 1, F.col("h").cast("int")), F.array().cast(firsts.schema["first"].dataType))
    heads = convs.join(firsts, "of", "left").select("conv_id", head.alias("head"))
    heads = materialise(heads, "heads")

    skipped = F.greatest(taken - F.col("at"), F.lit(0))
    own = (
        runs.where(F.col("at") + F.size("d1") > taken)
        .select("conv_id", (F.greatest("at", taken) - taken).alias("at"), *_from(skipped))
    )
    opening = own.where("at = 0").drop("at")
    joined = heads.join(opening, "conv_id", "left")
    none = F.array().cast("array<bigint>")
    whole = [F.concat(F.col(f"head.t.{c}"), F.coalesce(c, none)).alias(c) for c in ("d1", "d2", "nb")]
    first = joined.select("conv_id", F.lit(0).cast("long").alias("depth"), *whole)
    sizes = heads.select("conv_id", F.size("head").alias("b"))
    rest = own.where("at > 0").join(sizes, "conv_id")
    rest = rest.select("conv_id", (F.col("at") + F.col("b")).alias("depth"), "d1", "d2", "nb")
    return first.unionByName(rest)


# --- segments with their nodes -------------------------------------------------------------------

_SUMMED = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64())]
    + [("d1", _LONGS), ("d2", _LONGS), ("nb", _LONGS)]
)
_CHAINED = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "s1", "s2", "e1", "e2")])
KEYS = ["s1", "s2", "e1", "e2"]


def _sum_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: tuple[list[int], list[int]] = ([], [])
        for depth, d1, d2 in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            for terms, out in zip(turn_terms(np.asarray(d1, np.int64), np.asarray(d2, np.int64), depth), sums, strict=True):
                out.append(_signed(terms.sum(dtype=np.uint64)))
        arrays = [batch.column(0), batch.column(1), pa.array(sums[0]), pa.array(sums[1])]
        arrays += [batch.column(i).cast(_LONGS) for i in (2, 3, 4)]
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(arrays, schema=_SUMMED)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start and end nodes of the segments of conversations, which follow each other."""

    def rows() -> Iterator[tuple]:
        conv, key = None, (0, 0)
        for batch in batches:
            for c, depth, t1, t2 in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                start = key if c == conv else (0, 0)
                key = tuple((a + b) & (2**64 - 1) for a, b in zip(start, (t1, t2), strict=True))
                conv = c
                yield (c, depth, *map(_signed, start), *map(_signed, key))

    yield from _batches(rows(), _CHAINED)


def segments_of(paths: DataFrame) -> DataFrame:
    """Paths with the keys of the nodes before and after each segment, ``s1, s2`` and ``e1, e2``."""
    ordered = paths.select("conv_id", "depth", "d1", "d2", "nb")
    summed = materialise(ordered.mapInArrow(_sum_segments, _sql(_SUMMED)), "segments")
    zero = F.lit(0).cast("long")
    first = summed.where("depth = 0").select(
        "conv_id", "depth", zero.alias("s1"), zero.alias("s2"), F.col("t1").alias("e1"),
        F.col("t2").alias("e2"), "d1", "d2", "nb",
    )
    later = summed.where("depth > 0")
    # Only keys of conversations of several segments are chained, without their turns.
    light = summed.select("conv_id", "depth", "t1", "t2").join(
        later.select("conv_id").distinct(), "conv_id", "left_semi"
    )
    chained = (
        light.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_chain, _sql(_CHAINED))
    )
    later = later.drop("t1", "t2").join(chained, ["conv_id", "depth"])
    return first.unionByName(later)


# --- blocks --------------------------------------------------------------------------------------

#: Kinds of rows: a node, the node before a block, the last node of a segment.
NODE, ANCHOR, LAST = 0, 1, 2
_NODE = pa.schema(
    [("kind", pa.int32()), ("task", pa.int32()), ("no", pa.int64()), ("slot", pa.int32())]
    + [("base", pa.int32()), ("check", pa.int32())]
    + [(n, pa.int64()) for n in ("since", "depth", "k1", "k2", "p1", "p2", "nb", "conv", "n", "s1", "s2")]
)


def _block_rows(task: int, no: int, start: tuple[int, int], since: int, items: list[tuple]) -> Iterator[tuple]:
    """The nodes of one block of segments ``(conv, n, d1, d2, nb)`` that begin at one node."""
    dense: dict[tuple[int, int], int] = {}
    sequences = []
    for item in items:
        ids = [dense.setdefault(t, len(dense) + 1) for t in zip(item[2], item[3], strict=True)]
        sequences.append(ids)
    trie = DoubleArray(sorted(sequences))
    size = len(trie.check)
    count, least = [0] * size, [0] * size
    told: list[tuple | None] = [None] * size
    ends = []
    for ids, (conv, n, d1, d2, nb) in zip(sequences, items, strict=True):
        slot, keys = 0, None
        count[0] += n
        least[0] = min(least[0], conv) if told[0] else conv
        told[0] = told[0] or (since, *start, None, None, 0)
        for at, turn in enumerate(ids):
            slot = trie.child(slot, turn)
            count[slot] += n
            if told[slot]:
                least[slot] = min(least[slot], conv)
                continue
            if keys is None:
                terms = turn_terms(np.asarray(d1, np.int64), np.asarray(d2, np.int64), since)
                keys = list(zip(*map(_running, start, terms), strict=True))
            least[slot] = conv
            told[slot] = (since + at + 1, *keys[at + 1], *keys[at], nb[at])
        ends.append(slot)
    for slot, row in enumerate(told):
        if row:
            kind = ANCHOR if slot == 0 and since else NODE
            yield (kind, task, no, slot, trie.base[slot], trie.check[slot], since, *row, least[slot], count[slot], None, None)
    for slot in ends:
        yield (LAST, task, no, slot, None, None, since, *told[slot][:3], *[None] * 5, *start)


def _pack_blocks(block_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names = ("s1", "s2", "depth", "conv", "n", "d1", "d2", "nb")

        def rows() -> Iterator[tuple]:
            start, since, items, turns, no = None, 0, [], 0, 0
            for batch in batches:
                columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
                for s1, s2, depth, *item in zip(*columns, strict=True):
                    if items and ((s1, s2) != start or turns >= block_turns):
                        yield from _block_rows(task, no, start, since, items)
                        items, turns, no = [], 0, no + 1
                    start, since = (s1, s2), depth
                    items.append(tuple(item))
                    turns += len(item[2]) + 1
            if items:
                yield from _block_rows(task, no, start, since, items)

        yield from _batches(rows(), _NODE)

    return run


# --- sums ----------------------------------------------------------------------------------------

_SUMS = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "parent_conv_id", "saved", "leaves")])


def _sum_up(table: pa.Table) -> pa.Table:
    """Subtree sums of the nodes of one block, deepest first, by CHECK."""
    columns = {n: table.column(n).to_pylist() for n in table.column_names}
    at = {slot: i for i, slot in enumerate(columns["slot"])}
    saved, leaves, check, slots = columns["saved"], columns["leaves"], columns["check"], columns["slot"]
    order = sorted(range(len(slots)), key=columns["depth"].__getitem__, reverse=True)
    parents = []
    for i in order:
        if slots[i]:
            up = at[check[i]]
            saved[up] += saved[i]
            leaves[up] += leaves[i]
            parents.append(columns["conv_id"][up])
        else:
            parents.append(None)
    kept = [(i, p) for i, p in zip(order, parents, strict=True) if columns["kind"][i] == NODE]
    pick = lambda values: [values[i] for i, _ in kept]
    return pa.table(
        [pa.array(v, pa.int64()) for v in (pick(columns["k1"]), pick(columns["k2"]), [p for _, p in kept], pick(saved), pick(leaves))],
        schema=_SUMS,
    )


def _below(segments: DataFrame, owned: DataFrame, blocks: DataFrame) -> DataFrame:
    """What to add to the last nodes of segments, ``(task, no, slot, saved, leaves)``.

    A node below belongs to the later segment of its smallest member. For that conversation, what its
    later segments hold is added at the end of each segment before them.
    """
    mine = owned.where("since > 0").groupBy("conv_id", F.col("since").alias("depth")).agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    # One light row per segment of a conversation of several.
    several = segments.where("depth > 0").select("conv_id").distinct()
    chain = segments.select("conv_id", "depth", *KEYS).join(several, "conv_id", "left_semi")
    later = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(1, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(n).over(later), F.lit(0)).alias(n) for n in ("saved", "leaves")]
    extra = (
        chain.join(mine, ["conv_id", "depth"], "left")
        .select(*KEYS, *sums)
        .where("saved <> 0 OR leaves <> 0")
        .groupBy(*KEYS)
        .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    )
    lasts = blocks.where(F.col("kind") == LAST).select(
        "task", "no", "slot", "s1", "s2", F.col("k1").alias("e1"), F.col("k2").alias("e2")
    )
    added = lasts.join(extra, KEYS).groupBy("task", "no", "slot")
    return added.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))


_ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the sorted ids of each node's group, whose rows follow each other."""

    def rows() -> Iterator[tuple]:
        key, hashed = None, None
        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        yield (*key, hashed.hexdigest())
                    key, hashed = (k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    hashed.update(f",{conv}".encode())
        if key is not None:
            yield (*key, hashed.hexdigest())

    yield from _batches(rows(), _ENDS)


def trie_nodes(paths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of ``(conv_id, depth, d1, d2, nb)`` segments, with their aggregates."""
    segments = materialise(segments_of(paths), "trie-segments")
    items = segments.groupBy(*KEYS, "depth").agg(
        F.min("conv_id").alias("conv"),
        F.count("*").alias("n"),
        *[F.first(c).alias(c) for c in ("d1", "d2", "nb")],
    )
    blocks = materialise(
        items.repartitionByRange("s1", "s2", F.slice("d1", 1, ORDER_TURNS))
        .sortWithinPartitions("s1", "s2", "d1", "d2")
        .select("s1", "s2", "depth", "conv", "n", "d1", "d2", "nb")
        .mapInArrow(_pack_blocks(block_turns), _sql(_NODE)),
        "trie-blocks",
    )
    found = blocks.where(F.col("kind") == NODE).groupBy("k1", "k2").agg(
        F.min("conv").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        *[F.first(c).alias(c) for c in ("depth", "p1", "p2", "nb")],
    )
    found = materialise(found, "trie-nodes")
    children = found.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.agg(F.count("*").alias("n_children"))
    nodes = found.join(children, ["k1", "k2"], "left").select(
        "k1", "k2", "conv_id", "depth", "n_convs", "nb",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
    )
    nodes = materialise(nodes, "trie-merged")

    mine = (F.col("kind") == NODE) & (F.col("conv") == F.col("conv_id"))
    value = (F.col("n_convs") - 1) * F.col("merged_nb")
    held = (
        blocks.where(F.col("kind") != LAST)
        .select("kind", "task", "no", "slot", "check", "since", "depth", "k1", "k2", "conv")
        .join(nodes.select("k1", "k2", "conv_id", "n_convs", F.col("nb").alias("merged_nb"), "n_children"), ["k1", "k2"])
        .select(
            "kind", "task", "no", "slot", "check", "since", "depth", "k1", "k2", "conv_id",
            F.when(mine, value).otherwise(F.lit(0)).cast("long").alias("saved"),
            (mine & (F.col("n_children") == 0)).cast("long").alias("leaves"),
        )
    )
    if segments.where("depth > 0").take(1):
        held = materialise(held, "trie-held")
        more = _below(segments, held, blocks)
        held = held.join(more, ["task", "no", "slot"], "left").withColumns(
            {n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in ("saved", "leaves")}
        )
    sums = (
        held.select("kind", "task", "no", "slot", "check", "depth", "k1", "k2", "conv_id", "saved", "leaves")
        .groupBy("task", "no")
        .applyInArrow(_sum_up, _sql(_SUMS))
        .groupBy("k1", "k2")
        .agg(
            F.max("parent_conv_id").alias("parent_conv_id"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
        )
    )
    last = segments.groupBy("conv_id").agg(F.max_by(F.struct("e1", "e2"), "depth").alias("e"))
    ends = (
        last.select(F.col("e.e1").alias("k1"), F.col("e.e2").alias("k2"), "conv_id")
        .repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "conv_id")
        .mapInArrow(_hash_ends, _sql(_ENDS))
    )
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return (
        nodes.join(sums, ["k1", "k2"])
        .join(ends, ["k1", "k2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def prefix_trie(
    turns: DataFrame, segment: int = SEGMENT_TURNS, block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """The trie of rebuilt conversations given as ``(conv_id, turn, role, text)``.

    Returns per node conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn, nulls first; turns of equal number by the first 64 characters of role and
    text, then by their hash. Null role or text is empty. Repeated rows are turns of their own. Rows
    without conv_id belong to no conversation and are left out; other columns are ignored. An empty table
    gives no rows.
    """
    return trie_nodes(rebuilt_paths(turns, segment), block_turns)
