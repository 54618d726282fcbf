"""Arrays of doubles: element-wise Columns, and sums over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def vector_add(x: Column, y: Column) -> Column:
    """Element-wise sum over the common length."""
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a + b)


def vector_multiply(x: Column, y: Column) -> Column:
    """Element-wise product over the common length; ``x`` itself where ``y`` is null."""
    n = F.least(F.size(x), F.size(y))
    product = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a * b)
    return F.when(y.isNull(), x).otherwise(product)


def euclidean_distance(x: Column, y: Column) -> Column:
    n = F.least(F.size(x), F.size(y))
    squares = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: (a - b) * (a - b))
    return F.sqrt(total(squares))


def against(x: Column, value: Column, fn) -> Column:
    """``fn(element, value)`` for every element, with ``value`` computed once per row.

    The body of a lambda function is computed for every element, so a sum or a
    maximum of the whole array does not belong there.
    """
    return F.zip_with(x, F.array_repeat(value, F.size(x)), fn)


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(total(against(x, top, lambda v, m: F.exp(v - m))))


def normalise(x: Column) -> Column:
    return against(x, total(x), lambda v, mass: v / mass)


def once(x: Column) -> Column:
    """``x`` as the row of a generator, computed once per row.

    Filters are pushed below a projection by copying its expressions, also into
    functions that read them element by element; not below a generator.
    """
    return F.explode(F.array(x))


def vector_matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def matrix_vector(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def sum_runs(
    blocks: Iterator[tuple[np.ndarray, np.ndarray]],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sum rows of equal keys in a stream of ``(keys, rows)`` sorted by key.

    Holds one block and one open sum, whatever the number of rows of a key.
    """
    open_key, open_sum = None, None
    for keys, rows in blocks:
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums, keys = np.add.reduceat(rows, starts, axis=0), keys[starts]
        if open_key is not None:
            if keys[0] == open_key:
                sums[0] += open_sum
            else:
                sums = np.vstack([open_sum[None, :], sums])
                keys = np.r_[open_key, keys]
        open_key, open_sum = keys[-1], sums[-1].copy()
        if len(keys) > 1:
            yield keys[:-1], sums[:-1]
    if open_key is not None:
        yield np.asarray([open_key]), open_sum[None, :]


def sum_by_key(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Sum of a vector column by a BIGINT key.

    Each task sums its own rows first, so at most one row per key and task is shuffled.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ((b.column(0).to_numpy(), vector_matrix(b.column(1))) for b in batches)
        for keys, sums in sum_runs(blocks):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), matrix_vector(sums)], names=[key, vector]
            )

    def summed(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions(key).mapInArrow(
            reduce, f"{key} BIGINT, {vector} ARRAY<DOUBLE>"
        )

    return summed(summed(df.select(key, vector)).repartition(key))


def column_fold(df: DataFrame, vector: str, how: str) -> DataFrame:
    """Sum or maximum of a vector column over all rows: ``(topic INT, value DOUBLE)``.

    Each task folds its rows to one vector; only those are shuffled.
    """
    fold = {"sum": np.add, "max": np.maximum}[how]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for batch in batches:
            if batch.num_rows:
                row = fold.reduce(vector_matrix(batch.column(0)), axis=0)
                acc = row if acc is None else fold(acc, row)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([matrix_vector(acc[None, :])], names=[vector])

    parts = df.select(vector).mapInArrow(partial, f"{vector} ARRAY<DOUBLE>")
    agg = {"sum": F.sum, "max": F.max}[how]
    return (
        parts.select(F.posexplode(vector).alias("topic", "v"))
        .groupBy("topic")
        .agg(agg("v").alias("value"))
    )


def folded_vector(df: DataFrame, vector: str, how: str) -> np.ndarray:
    """The same as a NumPy vector: as many numbers as the vector is wide."""
    rows = column_fold(df, vector, how).collect()
    out = np.zeros(len(rows))
    for row in rows:
        out[row["topic"]] = row["value"]
    return out
