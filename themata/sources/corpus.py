"""Corpora: from encoded cells, from stored tables, and from raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themata import schemas
from themata.functions.codecs import decode_bow, decode_distribution, encode_bow
from themata.operators.ranking import dense_ids
from themata.storage import materialise

# A token is a run of at least this many ASCII letters.
MIN_TOKEN = 3
BAGS = "doc_id BIGINT, bag ARRAY<STRUCT<word: STRING, cnt: BIGINT>>"
NOT_LETTERS = "[^a-z]+"
# Tokens, and bytes of text, that are counted together, unless one document has more.
SLICE_TOKENS = 1 << 18
SLICE_BYTES = 6 * SLICE_TOKENS
# Vocabulary rows: bytes beside the word itself, and the longest word broadcast.
ROW_BYTES = 48
HEAD_WORD_LENGTH = 64


# --- encoded documents ------------------------------------------------------


def corpus_from_cells(cells: DataFrame, partitions: int | None = None) -> DataFrame:
    """Decode ``(doc_id, doc)`` cells to a corpus; malformed cells are left out."""
    good = decode_bow(cells).where(~F.col("corrupt")).select("doc_id", "word_ids", "word_cts")
    return good.repartition(partitions) if partitions else good


def corrupt_cells(cells: DataFrame) -> DataFrame:
    """The cells that :func:`corpus_from_cells` leaves out, for a quarantine table."""
    return decode_bow(cells).where("corrupt").select("doc_id", "doc")


def documents_only(corpus: DataFrame) -> DataFrame:
    """A corpus without document ids."""
    return corpus.select("word_ids", "word_cts")


def corpus_to_cells(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", encode_bow(F.col("word_ids"), F.col("word_cts")).alias("doc"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORPUS).parquet(path)


def topic_distributions(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Decode ``(doc_id, cell)`` to sparse document-topic distributions."""
    return (
        decode_distribution(cells, cell)
        .where(~F.col("corrupt"))
        .select("doc_id", "topic_idx", "prob")
    )


def explode_documents(corpus: DataFrame) -> DataFrame:
    """One row per document and word; a longer array is cut to the shorter one."""
    pairs = F.arrays_zip("word_ids", "word_cts")
    return (
        corpus.select("doc_id", F.explode(pairs).alias("p"))
        .where(F.col("p.word_ids").isNotNull() & F.col("p.word_cts").isNotNull())
        .select("doc_id", F.col("p.word_ids").alias("word_id"), F.col("p.word_cts").alias("cnt"))
    )


def batch_numbers(corpus: DataFrame, batch_size: int = 50) -> DataFrame:
    """``(doc_id, batch)``: the documents in key order, cut into batches of ``batch_size``.

    Keys order as text, as they do in a store whose row key is the decimal id. Only ids are sorted.
    """
    numbered = dense_ids(corpus.select("doc_id"), [F.col("doc_id").cast("string")], "_row")
    return numbered.select("doc_id", F.floor(F.col("_row") / batch_size).alias("batch"))


def document_batches(corpus: DataFrame, batch_size: int = 50) -> DataFrame:
    """The documents with the number of their batch. Ids are those of one document each."""
    return corpus.join(batch_numbers(corpus, batch_size), "doc_id")


# --- raw text ---------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_LETTERS), lambda t: F.length(t) >= MIN_TOKEN)


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the lists or texts of a column begin, and where the last one ends."""
    if pa.types.is_list(column.type):
        return column.offsets.to_numpy()
    if not len(column):
        return np.zeros(1, np.int32)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists or texts in the second column have ``size`` elements or bytes at
    most, or one row."""
    ends = _offsets(batch.column(1))
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
        following = max(at + 1, most)
        yield batch.slice(at, following - at)
        at = following


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-case texts in order, and the row of each: runs of ``MIN_TOKEN`` letters or more."""
    at = _offsets(texts).astype(np.int64)
    if at[0] == at[-1]:
        return pa.array([], pa.string()), np.empty(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    # Bytes of other characters in UTF-8 are no ASCII letters.
    letter = np.zeros(len(data) + 1, dtype=bool)
    letter[:-1] = (data - np.uint8(ord("a"))) < 26
    opens, closes = letter[:-1].copy(), letter[:-1] & ~letter[1:]
    opens[1:] &= ~letter[:-2]
    # No run goes on into the next text.
    edges = at[1:-1] - at[0]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges], closes[edges - 1] = letter[edges], letter[edges - 1]
    first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - first >= MIN_TOKEN
    first, end = first[long], end[long]
    change = np.zeros(len(data) + 1, np.int8)
    change[first] += 1
    change[end] -= 1
    letters = data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    ends = np.r_[0, np.cumsum(end - first)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(letters))
    return words, np.searchsorted(at, first + at[0], "right") - 1


def bags_of_words(documents: DataFrame) -> DataFrame:
    """``(doc_id, bag ARRAY<STRUCT<word, cnt>>)``, counted in slices of batches.

    The text of a document is in one row, so its tokens are found and counted where they are
    and nothing is shuffled. A batch has as many rows as Spark puts into it, however long they are;
    what counting needs beside it is bounded by the bytes of a slice.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, SLICE_BYTES)):
            found, docs = letter_runs(batch.column(1))
            words = found.dictionary_encode()
            size = max(1, len(words.dictionary))
            keys, counts = np.unique(
                docs * size + words.indices.to_numpy(), return_counts=True
            )
            bag = pa.StructArray.from_arrays(
                [words.dictionary.take(pa.array(keys % size)), pa.array(counts, pa.int64())],
                names=["word", "cnt"],
            )
            ends = np.searchsorted(keys // size, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), bag)],
                names=["doc_id", "bag"],
            )

    lower = documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return lower.mapInArrow(count, BAGS)


def word_counts(bags: DataFrame) -> DataFrame:
    """One row per document and word: ``(doc_id, word, cnt)``."""
    return bags.select("doc_id", F.inline("bag"))


def vocabulary(bags: DataFrame, min_df: int = 1) -> DataFrame:
    """Words by falling term frequency, ties by word; the most frequent one has id 0."""
    words = (
        word_counts(bags)
        .groupBy("word")
        .agg(F.sum("cnt").alias("tf"), F.count("*").alias("df"))
        .where(F.col("df") >= min_df)
    )
    ranked = dense_ids(words, [F.desc("tf"), F.asc("word")], "word_id")
    return ranked.select("word", "word_id", "tf", "df")


def encode_words(counts: DataFrame, vocab: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``(doc_id, word_id, cnt)`` for the words of the vocabulary.

    A vocabulary that fits ``broadcast_bytes`` is broadcast. Otherwise its most
    frequent words, as many as fit, are matched by broadcast and the remaining
    rare words by a shuffle, so no frequent word ends up as one shuffle key.
    """
    size = vocab.agg(
        F.coalesce(F.sum(F.octet_length("word") + ROW_BYTES), F.lit(0)).alias("bytes")
    ).first()["bytes"]
    keyed = vocab.select("word", "word_id")
    if size <= broadcast_bytes:
        matched = counts.join(F.broadcast(keyed), "word")
        return matched.select("doc_id", "word_id", F.col("cnt").cast("double").alias("cnt"))
    in_head = (F.col("word_id") < broadcast_bytes // (HEAD_WORD_LENGTH + ROW_BYTES)) & (
        F.octet_length("word") <= HEAD_WORD_LENGTH
    )
    looked_up = materialise(
        counts.join(F.broadcast(keyed.where(in_head)), "word", "left").select(
            "doc_id",
            "word_id",
            F.when(F.col("word_id").isNull(), F.col("word")).alias("word"),
            F.col("cnt").cast("double").alias("cnt"),
        ),
        "looked-up",
    )
    head = looked_up.where("word_id IS NOT NULL").select("doc_id", "word_id", "cnt")
    tail = (
        looked_up.where("word_id IS NULL")
        .drop("word_id")
        .join(keyed.where(~in_head), "word")
        .select("doc_id", "word_id", "cnt")
    )
    return head.union(tail)


def collect_documents(bow: DataFrame) -> DataFrame:
    """Long form to one row per document, words by rising id.

    A group is the words of one document, which came from one input row.
    """
    grouped = bow.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("word_id", "cnt"))).alias("_p")
    )
    return grouped.select(
        "doc_id", F.col("_p.word_id").alias("word_ids"), F.col("_p.cnt").alias("word_cts")
    )


def corpus_from_text(documents: DataFrame, vocab: DataFrame, **options) -> DataFrame:
    """Raw ``(doc_id, text)`` to a corpus over ``vocab``."""
    return collect_documents(
        encode_words(word_counts(bags_of_words(documents)), vocab, **options)
    )


# --- ids by first appearance ------------------------------------------------


def first_seen_words(documents: DataFrame) -> DataFrame:
    """``(word, vocab_id)``: words numbered by where they first appear."""
    seen = documents.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    first = seen.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return dense_ids(first, [F.col("at")], "vocab_id").select("word", "vocab_id")


def first_seen_ids(corpus: DataFrame) -> DataFrame:
    """``(word_id, dense_id)``: word ids numbered by where they first appear."""
    seen = corpus.select("doc_id", F.posexplode("word_ids").alias("pos", "word_id"))
    first = seen.groupBy("word_id").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return dense_ids(first, [F.col("at")], "dense_id").select("word_id", "dense_id")
