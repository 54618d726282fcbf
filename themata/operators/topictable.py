"""The topic-word table while it is trained: stored rows, deltas of touched words, a scale and a shift.

An M-step decays every row and adds the statistics of the words in the batch:

    lambda' = (1 - rho) lambda + rho eta + rho D / |mb| s

With lambda = scale * v + shift, the first two terms change only the two numbers, and the last one adds
``rho D / (|mb| scale') s`` to v. So an iteration writes the rows of the touched words and nothing else,
and v is the stored rows plus all deltas. Rows and deltas have the same buckets by word: adding them up
shuffles nothing, and only statistics move. Once the deltas outgrow the rows, they are merged into new
rows. The sums by topic follow from the deltas in the same way, by compensated summation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.functions.vectors import folded_vector, matrix_vector, sum_runs, vector_matrix
from themata.model import collect_rows
from themata.operators.mstep import m_step
from themata.storage import drop_table, write_buckets

# Deltas are merged into new rows beyond this number, or once they have so many rows a stored row.
MOST_DELTAS = 8
MOST_DELTA_ROWS = 2.0
# A smaller scale would cost digits of the deltas.
LEAST_SCALE = 2.0**-10

DELTA = "word_id BIGINT, lambda ARRAY<DOUBLE>"


def sum_statistics(stats: DataFrame, factor: float, buckets: int) -> DataFrame:
    """``factor`` times the sum of the statistics of every word: the one shuffle of an M-step."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ((b.column(0).to_numpy(), vector_matrix(b.column(1))) for b in batches)
        for keys, sums in sum_runs(blocks):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), matrix_vector(sums * factor)],
                names=["word_id", "lambda"],
            )

    # Statistics are many times the rows they sum up to, so their sorts follow their size; writing
    # brings the sums into their buckets.
    rows = stats.select("word_id", "s").repartition(F.col("word_id"))
    return rows.sortWithinPartitions("word_id").mapInArrow(reduce, DELTA)


def compensated(total: np.ndarray, carry: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``total + x``, with the digits that the sum loses added to ``carry``."""
    new = total + x
    large = np.abs(total) >= np.abs(x)
    return new, carry + np.where(large, (total - new) + x, (x - new) + total)


@dataclass(frozen=True)
class TopicTable:
    base: DataFrame
    buckets: int
    num_words: int
    # Sum of rows and deltas by topic: two parts of one number.
    sums: np.ndarray
    carry: np.ndarray
    deltas: tuple[DataFrame, ...] = ()
    delta_rows: int = 0
    scale: float = 1.0
    shift: float = 0.0
    # Folders that the run in progress has written and may remove.
    paths: tuple[str, ...] = ()
    # Word ids and rows v of a table within the broadcast limit, as the driver broadcasts them anyway.
    held: tuple[np.ndarray, np.ndarray] | None = None

    def lam(self) -> DataFrame:
        """``(word_id, lambda)``. Conditions on ``word_id`` reach the stored rows and all deltas."""
        joined = self.base.select("word_id", F.col("lambda").alias("_v"))
        names = [f"_d{i}" for i in range(len(self.deltas))]
        for name, delta in zip(names, self.deltas):
            part = delta.select("word_id", F.col("lambda").alias(name)).hint("merge")
            joined = joined.join(part, "word_id", "left")
        rows = F.col("_v")
        if names:
            rows = F.aggregate(
                F.array(*names),
                rows,
                lambda v, d: F.when(d.isNull(), v).otherwise(F.zip_with(v, d, lambda a, b: a + b)),
            )
        if (self.scale, self.shift) != (1.0, 0.0):
            scale, shift = F.lit(self.scale), F.lit(self.shift)
            rows = F.transform(rows, lambda v: v * scale + shift)
        return joined.select("word_id", rows.alias("lambda"))

    def held_lambda(self) -> tuple[np.ndarray, np.ndarray]:
        ids, rows = self.held
        return ids, rows * self.scale + self.shift

    def lambda_sums(self) -> np.ndarray:
        """Sum of lambda by topic, without reading a row."""
        return self.scale * (self.sums + self.carry) + self.shift * self.num_words

    def hold(self, num_topics: int, limit: int) -> TopicTable:
        """With the rows on the driver, if they are within ``limit`` bytes."""
        if self.held is not None or 8 * self.num_words * num_topics > limit:
            return self
        plain = replace(self, scale=1.0, shift=0.0)
        return replace(self, held=collect_rows(plain.lam(), num_topics))

    def is_due(self, scale: float) -> bool:
        """Whether deltas have to be merged before another one at this scale."""
        many = self.delta_rows > MOST_DELTA_ROWS * self.num_words
        return scale < LEAST_SCALE or len(self.deltas) >= MOST_DELTAS or many

    def add(
        self, stats: DataFrame, rho: float, eta: float, ratio: float, path: str
    ) -> tuple[TopicTable, int]:
        """The table after an M-step and the number of touched words.

        ``ratio`` is D / |mb|. Words without a row get none: a delta is joined from the rows.
        """
        scale = (1.0 - rho) * self.scale
        table = self
        if self.is_due(scale):
            if scale < LEAST_SCALE:
                return self._rewritten(stats, rho, eta, ratio, path)
            table = self.merged(f"{path}/rows")
            scale = (1.0 - rho) * table.scale
        shift = (1.0 - rho) * table.shift + rho * eta
        folder = f"{path}/delta"
        delta = write_buckets(
            sum_statistics(stats, rho * ratio / scale, self.buckets), folder, "word_id", self.buckets
        )
        if table.held is not None:
            ids, rows = table.held
            found, added = collect_rows(delta, rows.shape[1])
            at = np.searchsorted(ids, found)
            at[at == len(ids)] = 0
            known = ids[at] == found if len(ids) else np.zeros(len(found), dtype=bool)
            rows = rows.copy()
            rows[at[known]] += added[known]
            held, touched, added = (ids, rows), int(known.sum()), added[known].sum(axis=0)
        else:
            # One scan of the touched rows, not of the table.
            one = F.array(F.lit(1.0))
            sums = folded_vector(delta.select(F.concat("lambda", one).alias("v")), "v", "sum")
            held, touched = None, round(float(sums[-1])) if len(sums) else 0
            added = sums[:-1] if len(sums) else np.zeros(len(table.sums))
        total, carry = compensated(table.sums, table.carry, added)
        new = replace(
            table,
            sums=total,
            carry=carry,
            deltas=(*table.deltas, delta),
            delta_rows=table.delta_rows + touched,
            scale=scale,
            shift=shift,
            paths=(*table.paths, folder),
            held=held,
        )
        return new, touched

    def merged(self, path: str) -> TopicTable:
        """The same table without deltas, its rows written anew; the old ones are removed."""
        return self._replaced(self.lam(), path)

    def _rewritten(
        self, stats: DataFrame, rho: float, eta: float, ratio: float, path: str
    ) -> tuple[TopicTable, int]:
        """An M-step that leaves little or nothing of the old rows."""
        delta = sum_statistics(stats, 1.0, self.buckets)
        delta = write_buckets(delta, f"{path}/statistics", "word_id", self.buckets)
        updated = m_step(self.lam(), delta.withColumnRenamed("lambda", "s"), rho, eta, ratio)
        new, touched = self._replaced(updated, f"{path}/rows"), delta.count()
        drop_table(self.base.sparkSession, f"{path}/statistics")
        return new, touched

    def _replaced(self, rows: DataFrame, path: str) -> TopicTable:
        limit = self.held[1].nbytes if self.held is not None else 0
        new = store_rows(rows, self.buckets, len(self.sums), path, limit)
        for old in self.paths:
            drop_table(self.base.sparkSession, old)
        return replace(new, paths=(path,))


def table_of(
    base: DataFrame, buckets: int, num_words: int, lambda_sum: np.ndarray
) -> TopicTable:
    """A table of stored rows alone."""
    return TopicTable(base, buckets, num_words, lambda_sum, np.zeros(len(lambda_sum)))


def store_rows(
    lam: DataFrame, buckets: int, num_topics: int, path: str, limit: int = 0
) -> TopicTable:
    """Write a topic-word table in buckets by word; rows within ``limit`` bytes are held as well."""
    base = write_buckets(lam.select("word_id", "lambda"), path, "word_id", buckets)
    if limit:
        held = collect_rows(base, num_topics)
        new = table_of(base, buckets, len(held[0]), held[1].sum(axis=0))
        return replace(new, paths=(path,), held=held)
    one = F.array(F.lit(1.0))
    sums = folded_vector(base.select(F.concat("lambda", one).alias("v")), "v", "sum")
    new = table_of(base, buckets, round(float(sums[-1])), sums[:-1])
    return replace(new, paths=(path,))
