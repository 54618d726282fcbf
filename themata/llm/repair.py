"""Token ids on disk under Re-Pair grammar compression, with random access.

The ids of consecutive documents form blocks of bounded size. In each block, frequent pairs of
neighbouring symbols are replaced by nonterminals, again and again; a block stores its rules, the
expansion length of each nonterminal, and where each document begins in ids and in symbols, so that
any range of a document is decoded from the symbols that cover it. A round replaces all pairs that
occur ``MIN_COUNT`` times or more; where two such pairs overlap, the more frequent one wins. No pair
crosses the end of a document. Rounds end when one removes less than ``MIN_GAIN`` of the symbols.

File format: Parquet with one row per block. ``part`` and ``block`` give the order; ``first`` is the
number of ids before the block in its part; ``doc_ids``, ``doc_tokens`` and ``doc_symbols`` have one
value per document; ``base`` is the first nonterminal; ``symbols`` (the compressed ids), ``rules``
(left and right symbol of each nonterminal) and ``lengths`` are little-endian unsigned 32-bit
integers. Spark's writer commits files by task, so a lost executor leaves no half block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themata.llm.common import column, slices, text_of
from themata.llm.encoding import encoder

BLOCK_IDS = 1 << 18
MIN_COUNT = 4
#: Odd factors that spread pairs over slots.
SLOT_LEFT, SLOT_RIGHT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
MIN_GAIN = 0.03

BLOCKS = (
    "part int, block long, first long, n_tokens long, base long, doc_ids array<bigint>, "
    "doc_tokens array<bigint>, doc_symbols array<bigint>, symbols binary, rules binary, lengths binary"
)
DOCUMENTS = "doc_id long, part int, first long, n_tokens long, ids_crc32 long, n_symbols long"
IDS = "doc_id long, ids array<bigint>"


def _replace_round(
    seq: np.ndarray, last: np.ndarray, next_id: int, min_count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: the new symbols, their ends of documents, and the pairs replaced."""
    nothing = (seq, last, np.empty((0, 2), np.uint32))
    if seq.size < 2:
        return nothing
    # Pairs that lie within a document. Those whose slot is met too rarely are too rare themselves.
    slots = min(seq.size.bit_length(), 32)
    slot = ((seq[:-1] * SLOT_LEFT + seq[1:] * SLOT_RIGHT) >> np.uint32(32 - slots)).astype(np.int64)
    inner = np.flatnonzero((np.bincount(slot) >= min_count)[slot] & ~last[:-1])
    if not inner.size:
        return nothing
    # Sorted, equal ones form a run.
    left, right = seq[inner].astype(np.uint64), seq[inner + 1].astype(np.uint64)
    place, symbol = int(inner.size).bit_length(), int(seq.max()).bit_length()
    if 2 * symbol + place <= 64:
        # Pair and place in one number: sorting it is faster than sorting places.
        both = (((left << np.uint64(symbol)) | right) << np.uint64(place)) | np.arange(inner.size, dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << place) - 1)).astype(np.int64)
        key = both >> np.uint64(place)
    else:
        symbol = 32
        key = (left << np.uint64(32)) | right
        order = np.argsort(key, kind="stable")
        key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.append(starts, key.size))
    often = counts >= min_count
    if not often.any():
        return nothing
    pairs = key[starts[often]]
    # Rank 0 is the most frequent pair; ties go by the pair's value.
    by_rank = np.argsort(-counts[often], kind="stable")
    rank = np.empty(pairs.size, np.int32)
    rank[by_rank] = np.arange(pairs.size)
    of = np.full(seq.size + 1, pairs.size, np.int32)
    of[inner[order[np.repeat(often, counts)]] + 1] = np.repeat(rank, counts[often])
    hit = np.flatnonzero(of < pairs.size) - 1
    here, before, after = of[hit + 1], of[hit], of[np.minimum(hit + 2, seq.size)]
    keep = (here < before) & (here <= after)
    # Runs of one symbol: every second pair counted from the run's beginning. The pair before a run
    # decides whether the run's first pair is taken.
    same = before == here
    later = np.flatnonzero(same)
    if later.size:
        first = np.flatnonzero(~same)
        run = later - first[np.searchsorted(first, later) - 1]
        keep[later] = (run % 2 == 0) & (here <= after)[later]
    taken = hit[keep]
    # Neighbours that still overlap: the left one stays.
    while taken.size > 1:
        clash = np.concatenate(([False], np.diff(taken) == 1))
        if not clash.any():
            break
        clash[1:] &= ~clash[:-1]
        taken = taken[~clash]
    code = of[taken + 1]
    real = np.bincount(code, minlength=pairs.size) >= 2
    if not real.any():
        return nothing
    taken, code = taken[real[code]], code[real[code]]
    rules = pairs[by_rank[real]]
    rules = np.stack([rules >> np.uint64(symbol), rules & np.uint64((1 << symbol) - 1)], 1).astype(np.uint32)
    symbols = (next_id + (np.cumsum(real) - 1)[code]).astype(np.uint32)
    out = seq.copy()
    out[taken] = symbols
    ends = last.copy()
    ends[taken] = last[taken + 1]
    left = np.ones(seq.size, bool)
    left[taken + 1] = False
    return out[left], ends[left], rules


def compress(
    ids: np.ndarray,
    doc_tokens: np.ndarray,
    base: int,
    min_count: int = MIN_COUNT,
    min_gain: float = MIN_GAIN,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n, 2), expansion lengths (n), and symbols per document.

    ``doc_tokens`` are the documents' numbers of ids, each at least 1; ``base`` exceeds all ids.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(seq.size, bool)
    last[np.cumsum(doc_tokens) - 1] = True
    rules = np.empty((0, 2), np.uint32)
    while True:
        size = seq.size
        seq, last, added = _replace_round(seq, last, base + len(rules), min_count)
        rules = np.concatenate([rules, added])
        if not len(added) or size - seq.size < min_gain * size:
            break
    ends = np.flatnonzero(last)
    return seq, rules, rule_lengths(rules, base), np.diff(np.concatenate(([-1], ends)))


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion lengths; a rule's nonterminals have smaller numbers than its own."""
    lengths = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    sides = rules.astype(np.int64) - base
    while todo.size:
        parts = np.where(sides[todo] < 0, 1, lengths[np.maximum(sides[todo], 0)])
        known = (parts > 0).all(1)
        lengths[todo[known]] = parts[known].sum(1)
        todo = todo[~known]
    return lengths.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    seq = symbols.astype(np.uint32)
    while True:
        high = seq >= base
        if not high.any():
            return seq
        out = np.repeat(seq, 1 + high)
        at = np.flatnonzero(high) + np.arange(high.sum())
        pairs = rules[seq[high] - base]
        out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
        seq = out


class Block:
    """One row of the file, ready for decoding."""

    def __init__(self, row: dict) -> None:
        self.base = int(row["base"])
        self.doc_ids = row["doc_ids"]
        self.doc_tokens = np.array(row["doc_tokens"], np.int64)
        self.doc_symbols = np.array(row["doc_symbols"], np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<u4")

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)

    def read(self, document: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document (its place in the block); expands only symbols
        that cover the range."""
        before = int(self.doc_symbols[:document].sum())
        symbols = self.symbols[before : before + int(self.doc_symbols[document])]
        sizes = np.ones(symbols.size, np.int64)
        high = symbols >= self.base
        sizes[high] = self.lengths[symbols[high] - self.base]
        ends = np.cumsum(sizes)
        start, stop = max(start, 0), min(stop, int(ends[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        first = int(np.searchsorted(ends, start, "right"))
        final = int(np.searchsorted(ends, stop, "left"))
        at = int(ends[first] - sizes[first])
        return expand(symbols[first : final + 1], self.rules, self.base)[start - at : stop - at]


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS
) -> None:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Null text is the empty text; null ids come first; rows with equal ids are ordered by text and
    all kept; other columns are ignored. An empty table writes no blocks. Each document ends with
    ``end_id``. Documents are range-partitioned by doc_id; a task holds one block at a time,
    and a document longer than a block is a block of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        base = max(encode.library.get_vocab_size(), end_id + 1)
        end = np.array([end_id], "<u4").tobytes()
        part, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def row() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for _, x in held], np.int64)
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            symbols, rules, lengths, per_doc = compress(ids, counts, base)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part,
                        "block": number,
                        "first": first,
                        "n_tokens": ids.size,
                        "base": base,
                        "doc_ids": [d for d, _ in held],
                        "doc_tokens": counts.tolist(),
                        "doc_symbols": per_doc.tolist(),
                        "symbols": symbols.astype("<u4").tobytes(),
                        "rules": rules.astype("<u4").tobytes(),
                        "lengths": lengths.astype("<u4").tobytes(),
                    }
                ],
                schema=BLOCK_SCHEMA,
            )

        for batch in slices(batches, "text"):
            for doc_id, ids in zip(column(batch, "doc_id"), encode(column(batch, "text")), strict=True):
                if held and size + len(ids) // 4 + 1 > block_ids:
                    yield row()
                    number, first, held, size = number + 1, first + size, [], 0
                held.append((doc_id, ids + end))
                size += len(ids) // 4 + 1
        if held:
            yield row()

    ordered.mapInArrow(blocks, BLOCKS).write.mode("error").parquet(path)


BLOCK_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("first", pa.int64()),
        ("n_tokens", pa.int64()),
        ("base", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("doc_symbols", pa.list_(pa.int64())),
        ("symbols", pa.binary()),
        ("rules", pa.binary()),
        ("lengths", pa.binary()),
    ]
)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and n_symbols (its compressed length), all from the decoded files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _block_rows(batches):
            block = Block(row)
            data = block.ids().astype("<u4").tobytes()
            ends = np.cumsum(block.doc_tokens) * 4
            starts = ends - block.doc_tokens * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc_ids, pa.int64()),
                    pa.array([row["part"]] * len(crc), pa.int32()),
                    pa.array(row["first"] + starts // 4, pa.int64()),
                    pa.array(block.doc_tokens, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(block.doc_symbols, pa.int64()),
                ],
                names=["doc_id", "part", "first", "n_tokens", "ids_crc32", "n_symbols"],
            )

    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row per written part, each of which is one task's output: small by construction.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before = np.concatenate(([0], np.cumsum([n for _, n in sorted(sizes)])[:-1])) if sizes else []
    offsets = spark.createDataFrame(
        [(p, int(b)) for (p, _), b in zip(sorted(sizes), before, strict=True)], "part int, before long"
    )
    return (
        blocks.mapInArrow(decode, DOCUMENTS)
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "n_symbols"
        )
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with their ids: (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _block_rows(batches):
            block = Block(row)
            offsets = np.concatenate(([0], np.cumsum(block.doc_tokens))).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, pa.array(block.ids().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), ids], names=["doc_id", "ids"])

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(decode, IDS)
