"""The topic-word table: start values, sums, peaks, and rows of selected words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themata import schemas
from themata.functions.draws import gamma_draws
from themata.functions.special import digamma
from themata.functions.vectors import column_fold, folded_vector, matrix_vector, vector_matrix


def word_range(spark: SparkSession, low: int, high: int, slices: int) -> DataFrame:
    """The modelled word ids ``low .. high - 1``."""
    return spark.range(low, high, 1, slices).withColumnRenamed("id", "word_id")


def start_lambda(words: DataFrame, num_topics: int, start: str = "ones", seed: int = 0) -> DataFrame:
    """Start values for every word: all ones, or seeded Gamma(100, 1/100) draws."""
    if start == "ones":
        return words.select("word_id", F.array_repeat(F.lit(1.0), num_topics).alias("lambda"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            # No training iteration has this number, so documents draw other values.
            values = gamma_draws(ids, num_topics, seed, 2**32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), matrix_vector(values)], names=["word_id", "lambda"]
            )

    return words.select("word_id").mapInArrow(draw, schemas.LAMBDA)


def lambda_sums(lam: DataFrame) -> np.ndarray:
    """Sum of lambda by topic."""
    return folded_vector(lam, "lambda", "sum")


def lambda_peaks(lam: DataFrame) -> DataFrame:
    """Largest value by topic, at least 0: ``(topic, value)``."""
    peaks = column_fold(lam, "lambda", "max")
    return peaks.withColumn("value", F.greatest("value", F.lit(0.0)))


def peak_median(lam: DataFrame) -> DataFrame:
    """Median over the topics of their largest value: ``(peak_median)``."""
    return lambda_peaks(lam).agg(F.median("value").alias("peak_median"))


def rows_of_words(lam: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of the table whose word is among ``words``."""
    return lam.join(words.select("word_id"), "word_id", "left_semi")


def split_join(
    wanted: DataFrame,
    lam: DataFrame,
    num_topics: int,
    broadcast_bytes: int,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Join the table's rows, after ``prepare``, to ``wanted`` by ``word_id``.

    Ids are frequency ranks, so the rows of the frequent words are the first ones.
    As many of them as fit ``broadcast_bytes`` are joined by broadcast; only the
    rare words are shuffled, and none of them can dominate a partition.
    """
    head = broadcast_bytes // (8 * num_topics)
    if not head:
        return wanted.join(prepare(lam), "word_id")
    few, many = F.col("word_id") < head, F.col("word_id") >= head
    frequent = wanted.where(few).join(F.broadcast(prepare(lam.where(few))), "word_id")
    return frequent.unionByName(wanted.where(many).join(prepare(lam.where(many)), "word_id"))


def join_lambda(bow: DataFrame, lam: DataFrame, num_topics: int, broadcast_bytes: int) -> DataFrame:
    """``(doc_id, word_id, cnt, lambda)`` for the modelled words of a long corpus."""
    joined = split_join(bow, lam, num_topics, broadcast_bytes)
    return joined.select("doc_id", "word_id", "cnt", "lambda")


def document_rows(
    corpus: DataFrame, lam: DataFrame, num_topics: int, broadcast_bytes: int, most: int
) -> DataFrame:
    """``(doc_id, part, rows)``: the joined rows of a document by rising word, ``most`` in a part at most."""
    words = corpus.select("doc_id", F.posexplode(F.arrays_zip("word_ids", "word_cts")).alias("at", "w"))
    bow = words.select(
        "doc_id",
        F.floor(F.col("at") / most).alias("part"),
        F.col("w.word_ids").alias("word_id"),
        F.col("w.word_cts").alias("cnt"),
    )
    joined = split_join(bow, lam, num_topics, broadcast_bytes)
    rows = F.sort_array(F.collect_list(F.struct("word_id", "cnt", "lambda")))
    return joined.groupBy("doc_id", "part").agg(rows.alias("rows"))


def log_beta(lam: DataFrame, lambda_sum: np.ndarray) -> DataFrame:
    """E[log beta] for every row: ``(word_id, log_beta)``."""
    offset = digamma(lambda_sum)[None, :]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = digamma(vector_matrix(batch.column(1))) - offset
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), matrix_vector(values)], names=["word_id", "log_beta"]
                )

    return lam.select("word_id", "lambda").mapInArrow(
        expect, "word_id BIGINT, log_beta ARRAY<DOUBLE>"
    )
