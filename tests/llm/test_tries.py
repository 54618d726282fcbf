"""The prefix trie against a plain version."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from themata.llm.dialogue_trie import DoubleArray, prefix_trie
from themata.llm.queries import op12_double_array

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            lead = f"{role}\0{text}"[:64]
            own[conv].append(((turn is not None, turn or 0, lead, digest(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def plain(rows):
    """All prefixes as tuples."""
    paths = rebuilt(rows)
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
            if d:
                children[paths[c][: d - 1]].add(paths[c][:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = own + sum(saved[x] for x in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r[n] for n in COLUMNS) for r in frame.collect()), key=repr)


def test_double_array_holds_the_sequences():
    draw = random.Random(2)
    for _ in range(60):
        wide = draw.choice([2, 5, 300])
        sequences = [[draw.randint(1, wide) for _ in range(draw.randint(0, 7))] for _ in range(draw.randint(1, 200))]
        trie = DoubleArray(sorted(sequences))
        slots = {}
        for sequence in sequences:
            slot = 0
            for at, turn in enumerate(sequence):
                slot = trie.child(slot, turn)
                assert slot > 0
                assert slots.setdefault(tuple(sequence[: at + 1]), slot) == slot
        assert len(set(slots.values())) == len(slots)
        assert sum(c >= 0 for c in trie.check) == len(slots) + 1
        prefixes = set(slots) | {()}
        for prefix in list(prefixes)[:50]:
            for turn in range(1, wide + 1):
                assert (trie.child(slots.get(prefix, 0), turn) > 0) == ((*prefix, turn) in prefixes)


def test_query_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = op12_double_array(spark, SF)
    assert sorted(frame.columns) == sorted(COLUMNS)
    assert found(frame) == plain(rows)


def odd_rows():
    draw = random.Random(6)
    rows = [
        (None, 1, "user", "no conversation"), (0, None, None, None), (0, None, "user", "null turn"), (0, 1, "user", None),
        (-3, 1, "user", "minus"), (-5, 1, "user", "base"), (-5, 2, "user", "ä" * 70 + "b"), (-5, 2, "user", "ä" * 70 + "a"),
        (1, 1, "us", "er:x"), (1, 2, "user", ":x"), (2, 5, "user", "same"), (2, 5, "user", "same"), (7, 1, "", ""),
    ]
    texts = ["Hi", "How?", "Fine", "", "Ü", "long " * 2000]
    for c in range(10, 60):
        # Groups of copies, and a first turn that nearly all share.
        source = random.Random(c // 5 % 3)
        rows += [(c, t, "user" if t % 2 else "assistant", source.choice(texts)) for t in range(source.randint(0, 9) + c % 2)]
    # One conversation holds a third of all turns, others begin like it or are longer than a segment.
    rows += [(60, t, "user", draw.choice(texts[:4])) for t in range(300)]
    rows += [(c, t, r, x) for c in (61, 62, 63, 75) for _, t, r, x in rows[-300 : -300 + 20 * (c - 58)]]
    return rows


@pytest.mark.parametrize("segment, block", [(512, 1 << 15), (4, 40), (3, 1), (1, 7)])
def test_segments_blocks_and_odd_rows(spark, segment, block):
    rows = odd_rows()
    random.Random(1).shuffle(rows)
    names = ("depth", "d1", "n", "conv", "h", "of", "at", "task", "kind", "base")
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({n: F.lit("x") for n in names})
    assert found(prefix_trie(frame, segment, block)) == plain(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(empty).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    assert found(prefix_trie(spark.createDataFrame([(3, 1, "user", "x")], SCHEMA))) == plain([(3, 1, "user", "x")])
