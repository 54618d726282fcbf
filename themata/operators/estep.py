"""The E-step over a corpus.

Three layouts give the same numbers:

* ``broadcast``: the topic-word rows fit a broadcast; documents stay where they
  are and nothing is shuffled.
* ``blocks``: documents are hashed to blocks and each block receives the rows of
  its distinct words once.
* documents too wide for a block are updated by joins (``wide.py``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata import schemas
from themata.functions.memory import release_memory
from themata.functions.special import digamma
from themata.functions.vectors import matrix_vector, vector_matrix
from themata.model import TopicModel, collect_rows
from themata.operators.kernel import (
    Documents,
    InferenceSpec,
    TableRows,
    WordRows,
    infer,
    tile_bounds,
    tile_statistics,
)
from themata.operators.topicword import log_beta, rows_of_words
from themata.operators.wide import wide_e_step

SCHEMAS = {
    "stats": schemas.STATS,
    "docs": schemas.DOC_GAMMA,
    "both": f"{schemas.DOC_GAMMA}, {schemas.STATS}",
}
# Blocks per shuffle partition, so that chance collisions of blocks even out.
BLOCKS_PER_TASK = 2
# (document, word) pairs of a block, unless its limit or the number of tasks says otherwise.
BLOCK_PAIRS = 1 << 21
# Output batches stay below this size.
OUTPUT_BYTES = 16 << 20


def _columns(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch with the given columns and nulls for the others."""
    arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
    return pa.RecordBatch.from_arrays(
        [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema)],
        schema=schema,
    )


DOC_FIELDS = [
    pa.field("doc_id", pa.int64()),
    pa.field("gamma", pa.list_(pa.float64())),
    pa.field("bound", pa.float64()),
    pa.field("tokens", pa.float64()),
    pa.field("steps", pa.int32()),
]
STAT_FIELDS = [pa.field("word_id", pa.int64()), pa.field("s", pa.list_(pa.float64()))]
ARROW_SCHEMAS = {
    "stats": pa.schema(STAT_FIELDS),
    "docs": pa.schema(DOC_FIELDS),
    "both": pa.schema(DOC_FIELDS + STAT_FIELDS),
}


def _infer(
    batches: Iterator[pa.RecordBatch], words: WordRows, spec: InferenceSpec, want: str
) -> Iterator[pa.RecordBatch]:
    """Documents in, per-document results and one sum per touched word out."""
    schema = ARROW_SCHEMAS[want]
    sums = None
    if want != "docs":
        sums = np.zeros((len(words.word_ids), spec.num_topics))
        touched = np.zeros(len(words.word_ids), dtype=bool)
    for batch in batches:
        ids = batch.column(1)
        offsets = ids.offsets.to_numpy()
        docs = Documents.of(
            batch.column(0).to_numpy(),
            (offsets - offsets[0]).astype(np.int64),
            ids.flatten().to_numpy(),
            batch.column(2).flatten().to_numpy(),
            words,
        )
        for tile, res in infer(docs, words, spec):
            if sums is not None:
                rows, s = tile_statistics(tile, words, res)
                sums[rows] += s
                touched[rows] = True
            if want != "stats":
                bound, tokens = tile_bounds(tile, words, res, spec.alpha)
                yield _columns(
                    schema,
                    len(res.gamma),
                    doc_id=tile.doc_ids,
                    gamma=matrix_vector(res.gamma),
                    bound=bound,
                    tokens=tokens,
                    steps=res.steps,
                )
    if sums is not None:
        rows = np.flatnonzero(touched)
        step = max(1, OUTPUT_BYTES // (8 * spec.num_topics))
        for at in range(0, len(rows), step):
            cut = rows[at : at + step]
            yield _columns(
                schema, len(cut), word_id=words.word_ids[cut], s=matrix_vector(sums[cut])
            )


def _broadcast_e_step(
    corpus: DataFrame,
    rows: tuple[np.ndarray, np.ndarray],
    lambda_sum: np.ndarray,
    spec: InferenceSpec,
    want: str,
    resources: ExitStack,
) -> DataFrame:
    """``rows`` are within the broadcast limit: the caller has checked their size."""
    shared = corpus.sparkSession.sparkContext.broadcast((*rows, digamma(lambda_sum)))
    resources.callback(shared.destroy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _infer(batches, TableRows(*shared.value), spec, want)
        release_memory()

    return corpus.mapInArrow(run, SCHEMAS[want])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of each block once; all documents of a block are in one task."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        ids = batch.column(1).flatten().to_numpy()
        of = np.repeat(blocks, sizes)
        for block in np.unique(of):
            parts = held.setdefault(int(block), [])
            parts.append(np.unique(ids[of == block]))
            if len(parts) > 1 and len(parts[-1]) >= len(parts[0]):
                held[int(block)] = [np.unique(np.concatenate(parts))]
    for block, parts in held.items():
        found = np.unique(np.concatenate(parts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found), block)), pa.array(found)], names=["block", "word_id"]
        )


def _block_e_step(
    corpus: DataFrame,
    model: TopicModel,
    blocks: int,
    spec: InferenceSpec,
    want: str,
    broadcast_bytes: int,
    resources: ExitStack,
) -> DataFrame:
    placed = corpus.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    # Ids are frequency ranks: the first rows, as many as fit, are those that most blocks need. All
    # tasks get them, and only the rare words of a block are looked up by a shuffle.
    head = broadcast_bytes // (8 * spec.num_topics)
    rare = F.col("word_id") >= head
    shared = corpus.sparkSession.sparkContext.broadcast(
        (*collect_rows(model.lam.where(~rare), spec.num_topics), digamma(model.lambda_sum))
    )
    resources.callback(shared.destroy)
    rare_ids = F.filter("word_ids", lambda w: w >= head).alias("word_ids")
    # A word that several documents of a block have counts once.
    words = placed.select("block", rare_ids).repartition("block").mapInArrow(
        _distinct_words, "block BIGINT, word_id BIGINT"
    )
    # The join leaves out the table's other words.
    found = words.join(log_beta(model.lam.where(rare), model.lambda_sum), "word_id")
    needed = found.select(F.col("block").alias("for_block"), "word_id", "log_beta")

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        schema = ARROW_SCHEMAS[want]
        if not docs.num_rows:
            return schema.empty_table()
        ids, lam, log_sums = shared.value
        here = np.unique(docs.column("word_ids").combine_chunks().flatten().to_numpy())
        at = np.flatnonzero(np.isin(ids, here[here < head], assume_unique=True))
        ids, rows = ids[at], digamma(lam[at]) - log_sums
        if found.num_rows:
            ids = np.r_[ids, found.column("word_id").to_numpy()]
            rows = np.concatenate([rows, vector_matrix(found.column("log_beta"))])
        if not len(ids):
            return schema.empty_table()
        words = WordRows(ids, rows)
        batches = docs.select(["doc_id", "word_ids", "word_cts"]).to_batches()
        return pa.Table.from_batches(_infer(batches, words, spec, want), schema=schema)

    return (
        placed.groupBy("block")
        .cogroup(needed.groupBy("for_block"))
        .applyInArrow(run, SCHEMAS[want])
    )


def start_gamma(corpus: DataFrame, spec: InferenceSpec) -> DataFrame:
    """``(doc_id, gamma)``: what inference starts from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gamma = spec.start(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), matrix_vector(gamma)], names=["doc_id", "gamma"]
            )

    return corpus.select("doc_id").mapInArrow(run, "doc_id BIGINT, gamma ARRAY<DOUBLE>")


def e_step(
    corpus: DataFrame,
    model: TopicModel,
    spec: InferenceSpec,
    want: str,
    broadcast_bytes: int = 64 << 20,
    block_bytes: int = 256 << 20,
    resources: ExitStack | None = None,
) -> DataFrame:
    """Infer every document of ``corpus`` that has a modelled word.

    ``want`` is ``docs`` for one row per document, ``stats`` for sufficient
    statistics, partly summed by word, or ``both``. Closing ``resources`` frees
    what the result needs, so only after its last use; without it, it stays until
    the session ends.
    """
    resources = resources or ExitStack()
    corpus = corpus.select("doc_id", "word_ids", "word_cts")
    if model.table_bytes <= broadcast_bytes:
        return _broadcast_e_step(corpus, model.rows(), model.lambda_sum, spec, want, resources)

    size = F.size("word_ids")
    pairs, widest = corpus.agg(
        F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))
    ).first()
    word_bytes = 8 * model.num_topics
    # The corpus has at most as many distinct words as (document, word) pairs.
    if pairs * word_bytes <= broadcast_bytes:
        words = corpus.select(F.explode("word_ids").alias("word_id")).distinct()
        found = collect_rows(rows_of_words(model.lam, words), model.num_topics)
        return _broadcast_e_step(corpus, found, model.lambda_sum, spec, want, resources)

    limit = max(1, block_bytes // word_bytes)
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each block brings rows of its own for the words that it shares with others, so a small corpus
    # gets as many blocks as keep all cores busy, and not as many as there are partitions.
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    enough = max(BLOCKS_PER_TASK * cores, math.ceil(pairs / BLOCK_PAIRS))
    blocks = max(min(BLOCKS_PER_TASK * tasks, enough), math.ceil(pairs / limit))
    narrow = corpus.where(size <= limit) if widest > limit else corpus
    result = _block_e_step(narrow, model, blocks, spec, want, broadcast_bytes, resources)
    if widest > limit:
        wide = wide_e_step(corpus.where(size > limit), model, spec, broadcast_bytes, resources)
        result = result.unionByName(wide.outputs(want))
    return result
