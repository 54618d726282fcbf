"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing looks only at lengths, and lengths are whole numbers up to the capacity. So the
driver plans with the histogram of lengths (at most ``capacity`` rows, whatever the corpus): it takes
the lengths in falling order and finds for each the tightest open bin by a segment tree over the
remaining capacities. Pieces of equal length and bins of equal remainder are interchangeable, so one
step of the plan deals a run of pieces to a run of bins. A piece then finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themata.llm.common import column, release_memory, slices, text_of
from themata.llm.encoding import encoder
from themata.storage import materialise

CAPACITY = 1024

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long{}"
)
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that counts them.

    ``tightest(need)`` is the smallest remainder of an open bin that is at least ``need``, or -1.
    Bins are kept as runs (first, count) of consecutive sequence numbers.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(self.leaves)]

    def _add(self, remainder: int, count: int) -> None:
        at = remainder + self.leaves
        while at:
            self.tree[at] += count
            at //= 2

    def put(self, remainder: int, first: int, count: int) -> None:
        self.runs[remainder].append((first, count))
        self._add(remainder, count)

    def take(self, remainder: int, most: int) -> tuple[int, int]:
        first, count = self.runs[remainder].popleft()
        if count > most:
            self.runs[remainder].appendleft((first + most, count - most))
            count = most
        self._add(remainder, -count)
        return first, count

    def tightest(self, need: int) -> int:
        at = need + self.leaves
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset), by length and rank."""
    bins = OpenBins(capacity)
    sequences = 0
    runs = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remainder = bins.tightest(length)
            if remainder < 0:
                # Each new bin takes as many pieces of this length as fit before the next one opens.
                fit = capacity // length
                count, deep = (left // fit, fit) if left >= fit else (1, left)
                for level in range(deep):
                    runs.append((length, rank, count, sequences, level * length))
                    rank += count
                left -= count * deep
                if capacity - deep * length:
                    bins.put(capacity - deep * length, sequences, count)
                sequences += count
                continue
            # No open bin lies between the length and this remainder, so a bin that took a piece is
            # the tightest for the next one, until it is too full.
            fit = remainder // length
            first, count = bins.take(remainder, max(1, left // fit))
            deep = min(fit, left)
            for level in range(deep):
                runs.append((length, rank, count, first, capacity - remainder + level * length))
                rank += count
            left -= count * deep
            if remainder - deep * length:
                bins.put(remainder - deep * length, first, count)
    return runs


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """One row per piece, with its place among the pieces of its length in its task.

    Only documents of more than ``capacity`` ids are cut, into full pieces after a first piece that
    holds the rest.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            for doc_id, ids in zip(column(batch, "doc_id"), encode(column(batch, "text")), strict=True):
                data = ids + end
                total = len(data) // 4
                edges = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    held = data[4 * a : 4 * b]
                    values = (doc_id, piece, a, b - a, zlib.crc32(held), part, seen[b - a], held)
                    for target, value in zip(out, values, strict=True):
                        target.append(value)
                    seen[b - a] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
            n = 8 if keep_ids else 7
            yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, PIECES.format(", ids binary" if keep_ids else ""))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Null text is the empty text, which is its end id alone. Repeated and null ids are packed row by
    row; other columns are ignored; an empty table gives no rows. Returns doc_id, piece, start,
    length, ids_crc32, sequence_id, offset, and the piece's ids as bytes if ``keep_ids``.
    """
    spark = docs.sparkSession
    # Written once: the ranks below have to come from the same pieces that are packed.
    pieces = materialise(cut_documents(docs, vocabulary, end_id, capacity, keep_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per length and task: a length's group is as long as the number of tasks.
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1 << 48)
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            length = get("length").to_numpy(zero_copy_only=False)
            rank = (get("place").to_numpy(zero_copy_only=False) + get("base").to_numpy(zero_copy_only=False))
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            arrays = [get(n) for n in names] + [pa.array(sequence), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    schema = PACKED.replace("sequence_id", "ids binary, sequence_id") if keep_ids else PACKED
    return pieces.join(bases, ["length", "part"]).mapInArrow(place, schema)
