"""The E-step of documents whose word rows do not fit one task.

The (document, word) rows stay a table. Every step joins the current document
weights to it, sums partial vectors by document and writes the new state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.functions.special import dirichlet_expectation, lgamma
from themata.functions.vectors import matrix_vector, sum_by_key, vector_matrix
from themata.model import TopicModel
from themata.operators.kernel import TINY, InferenceSpec
from themata.operators.topicword import log_beta, split_join
from themata.storage import drop_table, new_folder, write_table

STATE = "doc_id BIGINT, gamma ARRAY<DOUBLE>, theta ARRAY<DOUBLE>, steps INT, active BOOLEAN"
# One hot document is spread over this many keys when its state is not broadcast.
PARTS = 64


def _state(doc_ids, gamma: np.ndarray, steps: np.ndarray, active: np.ndarray) -> pa.RecordBatch:
    theta = np.exp(dirichlet_expectation(gamma))
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            matrix_vector(gamma),
            matrix_vector(theta),
            pa.array(steps, pa.int32()),
            pa.array(active, pa.bool_()),
        ],
        names=["doc_id", "gamma", "theta", "steps", "active"],
    )


def _partial_sums(doc_ids: np.ndarray, values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Sum the rows of each document within a batch, before they are shuffled."""
    order = np.argsort(doc_ids, kind="stable")
    doc_ids = doc_ids[order]
    first = np.flatnonzero(np.r_[True, doc_ids[1:] != doc_ids[:-1]])
    sums = np.add.reduceat(values[order], first, axis=0)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids[first], pa.int64()), matrix_vector(sums)], names=names
    )


@dataclass(frozen=True)
class WideResult:
    rows: DataFrame
    state: DataFrame
    spec: InferenceSpec
    broadcast_state: bool

    def _weighted(self, weight: str) -> DataFrame:
        return _with_state(self.rows, self.state, self.broadcast_state, weight)

    def stats(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    beta, theta, ratio = _ratio(batch)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1), matrix_vector(beta * theta * ratio[:, None])],
                        names=["word_id", "s"],
                    )

        return self._weighted("theta").mapInArrow(run, "word_id BIGINT, s ARRAY<DOUBLE>")

    def docs(self) -> DataFrame:
        spec = self.spec

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                    _, one, back = np.unique(ids, return_index=True, return_inverse=True)
                    log_theta = dirichlet_expectation(vector_matrix(batch.column(4))[one])
                    x = vector_matrix(batch.column(3)) + log_theta[back]
                    top = x.max(axis=1)
                    log_phi = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
                    yield _partial_sums(
                        ids,
                        np.stack([counts * log_phi, counts], axis=1),
                        ["doc_id", "sums"],
                    )

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            alpha = spec.alpha
            for batch in batches:
                if batch.num_rows:
                    gamma, sums = vector_matrix(batch.column(1)), vector_matrix(batch.column(3))
                    bound = (
                        (alpha - gamma) * dirichlet_expectation(gamma)
                        + lgamma(gamma)
                        - lgamma(alpha)
                    ).sum(axis=1)
                    bound += lgamma(alpha.sum()) - lgamma(gamma.sum(axis=1)) + sums[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0),
                            batch.column(1),
                            pa.array(bound),
                            pa.array(sums[:, 1]),
                            batch.column(2),
                        ],
                        names=["doc_id", "gamma", "bound", "tokens", "steps"],
                    )

        sums = sum_by_key(
            self._weighted("gamma").mapInArrow(words, "doc_id BIGINT, sums ARRAY<DOUBLE>"),
            "doc_id",
            "sums",
        )
        return (
            self.state.join(sums, "doc_id")
            .select("doc_id", "gamma", "steps", "sums")
            .mapInArrow(
                finish,
                "doc_id BIGINT, gamma ARRAY<DOUBLE>, bound DOUBLE, tokens DOUBLE, steps INT",
            )
        )

    def outputs(self, want: str) -> DataFrame:
        if want == "stats":
            return self.stats()
        if want == "docs":
            return self.docs()
        return self.docs().unionByName(self.stats(), allowMissingColumns=True)


def _ratio(batch: pa.RecordBatch):
    beta = np.exp(vector_matrix(batch.column(3)))
    theta = vector_matrix(batch.column(4))
    phi = (beta * theta).sum(axis=1) + TINY
    return beta, theta, batch.column(2).to_numpy() / phi


def _with_state(
    rows: DataFrame, state: DataFrame, broadcast_state: bool, weight: str = "theta"
) -> DataFrame:
    """Word rows with the weights of their document as the last column."""
    weights = state.select("doc_id", weight)
    if broadcast_state:
        joined = rows.join(F.broadcast(weights), "doc_id")
    else:
        parts = weights.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = rows.withColumn("part", F.pmod("word_id", F.lit(PARTS)).cast("int")).join(
            parts, ["doc_id", "part"]
        )
    return joined.select("doc_id", "word_id", "cnt", "log_beta", weight)


def wide_e_step(
    corpus: DataFrame,
    model: TopicModel,
    spec: InferenceSpec,
    broadcast_bytes: int,
    resources: ExitStack,
) -> WideResult:
    spark = corpus.sparkSession
    folder = new_folder(spark, "wide")
    resources.callback(drop_table, spark, folder)
    bow = corpus.select("doc_id", F.explode(F.arrays_zip("word_ids", "word_cts")).alias("p"))
    counts = bow.select(
        "doc_id", F.col("p.word_ids").alias("word_id"), F.col("p.word_cts").alias("cnt")
    )
    rows = write_table(
        split_join(
            counts,
            model.lam,
            spec.num_topics,
            broadcast_bytes,
            lambda lam: log_beta(lam, model.lambda_sum),
        ).select("doc_id", "word_id", "cnt", "log_beta"),
        f"{folder}/rows",
    )

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                gamma = spec.start(batch.column(0).to_numpy())
                yield _state(batch.column(0), gamma, np.zeros(n), np.ones(n, dtype=bool))

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                beta, _, ratio = _ratio(batch)
                yield _partial_sums(
                    batch.column(0).to_numpy(), beta * ratio[:, None], ["doc_id", "weight"]
                )

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            old, theta = vector_matrix(batch.column(1)), vector_matrix(batch.column(2))
            steps = batch.column(3).to_numpy()
            new = theta * vector_matrix(batch.column(4)) + spec.alpha
            if not np.isfinite(new).all():
                raise FloatingPointError("gamma is not finite; check lambda, alpha and the counts")
            moved = np.abs(new - old).mean(axis=1)
            yield _state(batch.column(0), new, steps + 1, moved >= spec.threshold)

    state = write_table(
        rows.select("doc_id").distinct().mapInArrow(begin, STATE), f"{folder}/state-0"
    )
    broadcast_state = state.count() * spec.num_topics * 8 <= broadcast_bytes
    for step in spec.steps():
        open_docs = state.where("active")
        weights = sum_by_key(
            _with_state(rows, open_docs, broadcast_state).mapInArrow(
                contributions, "doc_id BIGINT, weight ARRAY<DOUBLE>"
            ),
            "doc_id",
            "weight",
        )
        moved = (
            open_docs.join(weights, "doc_id")
            .select("doc_id", "gamma", "theta", "steps", "weight")
            .mapInArrow(update, STATE)
        )
        state = write_table(
            state.where("NOT active").unionByName(moved), f"{folder}/state-{step}"
        )
        drop_table(spark, f"{folder}/state-{step - 1}")
        if state.where("active").isEmpty():
            break
    return WideResult(rows, state, spec, broadcast_state)
