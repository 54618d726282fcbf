"""Options shared by the command-line jobs."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from themata import schemas
from themata.sources.corpus import corpus_from_cells, corrupt_cells, read_corpus


def add_corpus(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--corpus", required=True, help="folder of Parquet files")
    parser.add_argument(
        "--format",
        choices=("corpus", "cells"),
        default="corpus",
        help="rows of (doc_id, word_ids, word_cts), or of (doc_id, doc)",
    )
    parser.add_argument("--quarantine", help="folder for malformed cells")


def add_sizes(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--broadcast-bytes", type=int, help="largest table that is broadcast")
    parser.add_argument("--block-bytes", type=int, help="rows of a larger table in one task")


def sizes(args: argparse.Namespace, *names: str) -> dict[str, int]:
    """The given sizes, without those that are not set."""
    return {n: getattr(args, n) for n in names if getattr(args, n) is not None}


def load_corpus(
    spark: SparkSession, path: str, form: str, partitions: int | None, quarantine: str | None
) -> DataFrame:
    if form == "corpus":
        return read_corpus(spark, path)
    cells = spark.read.schema(schemas.CELLS).parquet(path)
    if quarantine:
        corrupt_cells(cells).write.mode("overwrite").parquet(quarantine)
    return corpus_from_cells(cells, partitions)


def flag(text: str) -> bool:
    return text.lower() in ("true", "1", "yes")
