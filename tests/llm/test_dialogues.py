"""Conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from themata.llm import dialogue_repair as R
from themata.llm.queries import op11_edit_lattice

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_search(marks):
    """All states row by row, insertions to a fixed point, whole labels compared."""
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def insert(states):
        changed = True
        while changed:
            changed = False
            for q, (cost, audit) in list(states.items()):
                for role, t in follows[q].items():
                    label = (cost + 3, audit + "I")
                    if role != "s" and label < states.get(t, (10**9,)):
                        states[t] = label
                        changed = True
        return states

    states = insert({"": (0, "")})
    for mark in marks:
        new = {}
        for q, (cost, audit) in states.items():
            options = [(q, 4, "D")]
            if mark != "d":
                extra = 3 if mark.isupper() else 0
                for role, t in follows[q].items():
                    if role == mark.lower():
                        options.append((t, extra, "K"))
                    if role != "s":
                        options.append((t, extra + 3, "R"))
            for t, price, letter in options:
                label = (cost + price, audit + letter)
                if label < new.get(t, (10**9,)):
                    new[t] = label
        states = insert(new)
    return min(states[q] for q in ("", "a") if q in states)


def plain_repair(rows):
    """The whole result of one conversation from its damaged rows ``(turn, role, text)``."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] + "\0" + r[2]))
    counts, seen, marks = defaultdict(int), set(), ""
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        if not body:
            counts["blank"] += 1
            marks += "d"
            continue
        if (role, text) in seen:
            counts["duplicate"] += 1
            marks += "d"
            continue
        seen.add((role, text))
        mark = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if body[-1] not in ".!?":
            counts["truncated"] += 1
            mark = mark.upper()
        marks += mark
    numbers = {t for t, _, _ in rows if t is not None}
    counts["gaps"] = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain_search(marks)
    out, rest = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)[1:]
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        out.append((role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal")
    return (*[counts[n] for n in names], cost, audit, hashlib.sha256(text.encode()).hexdigest())


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def found(frame):
    return {
        r["conv_id"]: tuple(r[n] for n in (*R.TOTALS, "audit", "repaired_sha256")) for r in frame.collect()
    }


def test_search_against_the_plain_one():
    for n in range(5):
        for marks in product("suaxUAd", repeat=n):
            marks = "".join(marks)
            assert R.search(marks, R.START, R.ACCEPTED) == plain_search(marks), marks
    draw = random.Random(3)
    for _ in range(300):
        marks = "".join(draw.choices("suaxSUAXd", weights=[1, 6, 6, 1, 1, 2, 2, 1, 2], k=draw.randint(5, 40)))
        assert R.search(marks, R.START, R.ACCEPTED) == plain_search(marks), marks


def test_blocks_join_to_the_whole_search():
    draw = random.Random(4)
    for _ in range(200):
        marks = "".join(draw.choices("suaxSUAXd", k=draw.randint(2, 24)))
        at = draw.randint(0, len(marks))
        joined = R.join_searches(R.all_searches(marks[:at]), R.all_searches(marks[at:]))
        assert joined == R.all_searches(marks)


def test_query_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain_repair(turns) for c, turns in plain_damage(rows).items()}
    frame = op11_edit_lattice(spark, SF)
    assert frame.count() == len(want)
    assert found(frame) == want


def odd_conversations():
    draw = random.Random(5)
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (None, None, "user", None),
        (2, 1, "", ""), (2, 1, "system", "S."), (2, 1, "system", "S."), (2, 9, "tool", "x"),
        (3, None, "user", "a" * 100_000 + "."), (3, 1, "assistant", " \t\n"), (4, -5, "User", "b!"),
        (4, 2**40, "assistant", "no end"), (5, 1, "user", "\x1c"), (6, 1, "user", "a\0b."), (6, 1, "user", "a\0a."),
    ]
    texts = ["One.", "Two", "Three!", "", "Four?", "Fünf.", "Six"]
    # One conversation holds more than half of all turns, with many repeats.
    rows += [(8, t // 2, draw.choice(["user", "assistant", "system"]), draw.choice(texts) + str(t % 90)) for t in range(400)]
    rows += [(9 + t % 20, t, draw.choice(["user", "assistant"]), draw.choice(texts)) for t in range(200)]
    return rows


@pytest.mark.parametrize("block_turns", [256, 7, 1])
def test_blocks_and_odd_rows(spark, block_turns):
    rows = odd_conversations()
    want = {c: plain_repair([(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in turns])
            for c, turns in ((c, [r for r in rows if r[0] == c]) for c in {r[0] for r in rows})}
    names = ("block", "blocks", "idx", "task", "no", "gone_", "edits", "cost", "audit", "copy")
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in names})
    repaired = R.repair(frame, block_turns=block_turns, joined_blocks=4)
    assert found(R.digests(repaired)) == want


def test_damage_of_odd_rows(spark):
    rows = odd_conversations()
    want = {c: plain_repair(turns) for c, turns in plain_damage(rows).items()}
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit(1))
    assert found(R.digests(R.repair(R.damage(frame)))) == want


def test_conversations_without_turns_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 1, "user", "a.", True), (2, 1, "user", "b.", True)], f"{SCHEMA}, gone boolean")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(R.digests(R.repair(frame))) == {1: nothing, 2: nothing}
    assert R.digests(R.repair(R.damage(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_repaired_turns_are_real_output(spark):
    rows = [(1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "user", "Again?"), (1, 4, "assistant", "Yes.")]
    (row,) = R.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (row["edits"], row["cost"]) == ("KDIKK", 7)
    want = [("user", "Hello."), ("assistant", ""), ("user", "Again?"), ("assistant", "Yes.")]
    assert [tuple(t) for t in row["repaired"]] == want
