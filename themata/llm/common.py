"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themata.functions.memory import release_memory  # noqa: F401
from themata.session import ship_package

#: Words: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows and characters that a Python step handles at once.
SLICE_ROWS = 512
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_fold(column: str, divisor: int) -> Column:
    """The remainder of the crc32 of a number written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def slices(
    batches: Iterator[pa.RecordBatch], column: str, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds a bounded number of rows and characters.

    A single text longer than the bound is a slice of its own.
    """
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        first = held = 0
        for at, size in enumerate(sizes.to_pylist()):
            if at > first and (at - first >= rows or held + (size or 0) > chars):
                yield batch.slice(first, at - first)
                first, held = at, 0
            held += size or 0
        if batch.num_rows > first:
            yield batch.slice(first)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def words_of(text: str) -> list[str]:
    """The words of a text: runs of anything but ASCII white space."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()  # the same for such texts, and faster
    return WORD.findall(text)
