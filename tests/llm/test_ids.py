"""Token ids in files and packing, against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from themata.llm import encoding, repair
from themata.llm.common import table
from themata.llm.encoding import WordEncoder, encoder
from themata.llm.packing import pack, plan
from themata.llm.queries import op1_repair_ids, op9_best_fit_packing, vocabulary_path

SF = "/root/testdata/sf0.001"
VOCABULARY = vocabulary_path("byte_bpe_50k.json")
ODD = [
    (7, None, 1),
    (3, "", 2),
    (5, "word " * 3000, 3),
    (5, "word " * 3000, 3),
    (5, "a  b\n\n c <|endoftext|>", 4),
    (None, "no id ½ 日本", 5),
]


def plain_ids(text: str | None, end: int) -> list[int]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, part int")


def test_cached_encoding_is_the_librarys():
    random.seed(1)
    letters = "ab'st \t\n\x1c\x851½²é日.!_ "
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(5000)]
    encode = encoder(VOCABULARY)
    assert encode(texts) == encode.encode_whole(texts)
    assert encode(texts) == encode.encode_whole(texts)


def test_words_with_signs_and_line_feeds_are_the_librarys(monkeypatch):
    random.seed(5)
    letters = "abÉß日ñ''0½.,#$%&*|<>_~^`!\n\n\u2028\u0301 "
    texts = ["x " + "".join(random.choice(letters) for _ in range(random.randint(0, 24))) for _ in range(8000)]
    words = ["".join(random.choice("abcdeéñ") for _ in range(6)) for _ in range(400)]
    ends = ["", ".", "###", ".$$$", "***", "%%%"]
    texts += [" ".join(w + random.choice(ends) + random.choice(["", "", "\nOnce,"]) for w in random.sample(words, 20)) + " a" for _ in range(200)]
    encode = WordEncoder(VOCABULARY)
    expected = encode.encode_whole(texts)
    assert encode(texts) == expected and encode(texts) == expected
    for bounds in ({"CACHED_WORDS": 20}, {"CACHED_LENGTH": 3}):
        with monkeypatch.context() as m:
            for name, value in bounds.items():
                m.setattr(encoding, name, value)
            small = WordEncoder(VOCABULARY)
            assert small(texts) == expected and small(texts) == expected
            assert len(small.cache) <= encoding.CACHED_WORDS and not small.cache.passing
    # Such words need the library's pattern for their ends only.
    fresh, whole = WordEncoder(VOCABULARY), []
    plain = fresh.encode_whole
    fresh.encode_whole = lambda x: (whole.append(len(x)), plain(x))[1]
    assert fresh(texts[8000:]) == expected[8000:]
    assert sum(whole) <= 200 + len(ends) + 2


def test_compression_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = rng.integers(1, 40, rng.integers(1, 12))
        ids = rng.integers(0, rng.integers(1, 5), counts.sum()).astype(np.uint32)
        symbols, rules, lengths, per_doc = repair.compress(ids, counts, 10, 2, 0.0)
        assert (repair.expand(symbols, rules, 10) == ids).all()
        assert per_doc.sum() == symbols.size and (per_doc > 0).all()
        for number, length in enumerate(lengths):
            assert repair.expand(np.array([10 + number]), rules, 10).size == length
    repeated = np.tile(np.arange(8, dtype=np.uint32), 400)
    assert repair.compress(repeated, np.array([3200]), 10)[0].size < 40


def test_random_access():
    rng = np.random.default_rng(1)
    counts = np.array([30, 1, 400, 7])
    ids = rng.integers(0, 3, counts.sum()).astype(np.uint32)
    symbols, rules, lengths, per_doc = repair.compress(ids, counts, 5)
    block = repair.Block(
        {
            "base": 5,
            "doc_ids": [1, 2, 3, 4],
            "doc_tokens": counts,
            "doc_symbols": per_doc,
            "symbols": symbols.astype("<u4").tobytes(),
            "rules": rules.astype("<u4").tobytes(),
            "lengths": lengths.astype("<u4").tobytes(),
        }
    )
    offsets = np.concatenate(([0], np.cumsum(counts)))
    for _ in range(300):
        d = rng.integers(0, 4)
        a, b = sorted(rng.integers(0, counts[d] + 1, 2))
        assert (block.read(d, a, b) == ids[offsets[d] + a : offsets[d] + b]).all()


def test_query_op1(spark):
    docs = table(spark, SF, "documents").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in op1_repair_ids(spark, SF).collect()}
    start = 0
    for row in docs:
        ids = plain_ids(row["text"], 0)
        got = found[row["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(found) == len(docs)


def test_odd_ids(spark, odd, tmp_path):
    for block_ids in (10, 1 << 18):
        path = str(tmp_path / f"ids-{block_ids}")
        repair.write_ids(odd, path, VOCABULARY, block_ids=block_ids)
        rows = repair.read_documents(spark, path).orderBy("start").collect()
        want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        assert [r["doc_id"] for r in rows] == [r[0] for r in want]
        assert [r["ids_crc32"] for r in rows] == [crc(plain_ids(r[1], 0)) for r in want]
        assert rows[-1]["start"] + rows[-1]["n_tokens"] == sum(len(plain_ids(r[1], 0)) for r in ODD)
        ids = repair.read_ids(spark, path).collect()
        assert sorted(map(str, (r["ids"] for r in ids))) == sorted(str(plain_ids(r[1], 0)) for r in ODD)
    path = str(tmp_path / "none")
    repair.write_ids(odd.limit(0), path, VOCABULARY)
    assert repair.read_documents(spark, path).count() == 0


def first_principles(histogram: dict[int, int], capacity: int) -> list[int]:
    bins: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            open_bins = [(room, i) for i, room in enumerate(bins) if room >= length]
            if open_bins:
                bins[min(open_bins)[1]] -= length
            else:
                bins.append(capacity - length)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    random.seed(3)
    for _ in range(500):
        capacity = random.randint(3, 40)
        histogram = {random.randint(1, capacity): random.randint(1, 9) for _ in range(random.randint(0, 8))}
        held, ranks = defaultdict(list), defaultdict(list)
        for length, rank, count, first, offset in plan(histogram, capacity):
            for at in range(count):
                held[first + at].append((offset, length))
                ranks[length].append(rank + at)
        assert all(sorted(ranks[n]) == list(range(k)) for n, k in histogram.items())
        rooms = []
        for pieces in held.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            rooms.append(capacity - end)
        assert sorted(rooms) == first_principles(histogram, capacity)


def check_packed(rows, docs, capacity):
    want = sorted(
        (doc_id is not None, doc_id or 0, piece, start, length, crc(ids[start : start + length]))
        for doc_id, ids in docs
        for piece, (start, length) in enumerate(cuts(len(ids), capacity))
    )
    assert want == sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"])
        for r in rows
    )
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    histogram = defaultdict(int)
    for r in rows:
        histogram[r["length"]] += 1
    assert len(held) == len(first_principles(histogram, capacity))


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    edges = [0, *range(total % capacity or capacity, total + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def test_query_op9(spark):
    docs = [(r["doc_id"], plain_ids(r["text"], 2)) for r in table(spark, SF, "documents").collect()]
    check_packed(op9_best_fit_packing(spark, SF).collect(), docs, 1024)


def test_odd_packing(spark, odd):
    clash = odd.withColumn("length", F.lit("x")).withColumn("place", F.lit(None).cast("int"))
    docs = [(r[0], plain_ids(r[1], 2)) for r in ODD]
    check_packed(pack(clash, VOCABULARY, capacity=16).collect(), docs, 16)
    with_ids = pack(clash.repartition(3), VOCABULARY, capacity=16, keep_ids=True).collect()
    check_packed(with_ids, docs, 16)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in with_ids)
    assert pack(odd.limit(0), VOCABULARY).count() == 0
