"""A topic model: the topic-word table and a handful of numbers per topic."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame

from themata.functions.vectors import vector_matrix

if TYPE_CHECKING:
    from themata.operators.topictable import TopicTable


@dataclass(frozen=True)
class TopicModel:
    lam: DataFrame
    alpha: np.ndarray
    eta: float
    num_updates: int
    num_topics: int
    total_docs: int
    num_words: int
    lambda_sum: np.ndarray
    # The save that holds this model, if one does.
    source: str | None = None
    # How the table is stored, if it is one that training can add to.
    table: TopicTable | None = None

    @property
    def table_bytes(self) -> int:
        """Size of the topic-word table as doubles."""
        return self.num_words * self.num_topics * 8

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ids and rows on the driver: the caller has checked their size."""
        if self.table is not None and self.table.held is not None:
            return self.table.held_lambda()
        return collect_rows(self.lam, self.num_topics)


def collect_rows(lam: DataFrame, num_topics: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word_id, lambda)`` as two arrays, sorted by word: the caller has checked the size."""
    table = lam.select("word_id", "lambda").toArrow()
    ids = table.column("word_id").to_numpy()
    rows = vector_matrix(table.column("lambda")).reshape(len(ids), num_topics)
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order]
