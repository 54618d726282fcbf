"""The update of the document prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themata.functions.special import dirichlet_expectation, trigamma
from themata.functions.vectors import folded_vector, matrix_vector, vector_matrix


def mean_log_theta(doc_gamma: DataFrame) -> tuple[np.ndarray, int]:
    """Mean of E[log theta] over the documents, by topic, and their number.

    Tasks sum their own documents; T + 1 numbers reach the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row = dirichlet_expectation(vector_matrix(batch.column(0))).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [matrix_vector(np.r_[row, batch.num_rows][None, :])], names=["v"]
                )

    parts = doc_gamma.select("gamma").mapInArrow(partial, "v ARRAY<DOUBLE>")
    sums = folded_vector(parts, "v", "sum")
    if not len(sums):
        return sums, 0
    return sums[:-1] / sums[-1], round(sums[-1])


def newton_step(alpha: np.ndarray, mean_log: np.ndarray, docs: int) -> np.ndarray:
    """One Newton step of the Dirichlet likelihood (Huang 2005, section 3.3)."""
    gradient = docs * (mean_log - dirichlet_expectation(alpha))
    diagonal = -docs * trigamma(alpha)
    z = docs * float(trigamma(alpha.sum()))
    b = (gradient / diagonal).sum() / (1.0 / z + (1.0 / diagonal).sum())
    return -(gradient - b) / diagonal


def update_alpha(alpha: np.ndarray, doc_gamma: DataFrame, weight: float) -> np.ndarray:
    """The new prior, or the old one if a value would not stay above 0."""
    mean_log, docs = mean_log_theta(doc_gamma)
    if not docs:
        return alpha
    new = alpha + weight * newton_step(alpha, mean_log, docs)
    return new if (new > 0).all() else alpha
