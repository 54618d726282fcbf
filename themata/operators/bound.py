"""The variational bound and held-out perplexity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.functions.special import digamma, lgamma
from themata.functions.vectors import folded_vector, matrix_vector, vector_matrix
from themata.model import TopicModel
from themata.operators.estep import e_step
from themata.operators.kernel import InferenceSpec


@dataclass(frozen=True)
class TopicBound:
    part1: float
    part2: float
    part3: float

    @property
    def total(self) -> float:
        return self.part1 + self.part2 + self.part3


def topic_bound(model: TopicModel, num_words: int | None = None) -> TopicBound:
    """The part of the bound that belongs to the topics, in one pass over lambda."""
    eta, log_sums = model.eta, digamma(model.lambda_sum)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lam = vector_matrix(batch.column(0))
                part1 = ((eta - lam) * (digamma(lam) - log_sums)).sum()
                part2 = (lgamma(lam) - lgamma(eta)).sum()
                yield pa.RecordBatch.from_arrays(
                    [matrix_vector(np.asarray([[part1, part2]]))], names=["parts"]
                )

    parts = model.lam.select("lambda").mapInArrow(partial, "parts ARRAY<DOUBLE>")
    part1, part2 = folded_vector(parts, "parts", "sum")
    words = model.num_words if num_words is None else num_words
    part3 = (lgamma(eta * words) - lgamma(model.lambda_sum)).sum()
    return TopicBound(float(part1), float(part2), float(part3))


@dataclass(frozen=True)
class Perplexity:
    corpus_bound: float
    topic_bound: float
    tokens: float
    raw_tokens: float

    @property
    def value(self) -> float:
        return -(self.corpus_bound + self.topic_bound) / self.tokens


def count_tokens(bow: DataFrame, low: int = 0) -> DataFrame:
    """Tokens of the words whose id is at least ``low``: ``(tokens)``."""
    return bow.where(F.col("word_id") >= low).agg(
        F.coalesce(F.sum("cnt"), F.lit(0.0)).alias("tokens")
    )


def log_perplexity(
    documents: DataFrame,
    model: TopicModel,
    spec: InferenceSpec,
    tf_ranking_min: int = 0,
    **sizes,
) -> Perplexity:
    """Per-token bound of held-out documents, over the words the model knows.

    ``raw_tokens`` also counts the tokens of words outside the model.
    """
    docs = e_step(documents, model, spec, "docs", **sizes)
    bound, tokens = docs.agg(
        F.coalesce(F.sum("bound"), F.lit(0.0)), F.coalesce(F.sum("tokens"), F.lit(0.0))
    ).first()
    pairs = F.arrays_zip("word_ids", "word_cts")
    kept = F.filter(pairs, lambda p: p["word_ids"] >= tf_ranking_min)
    raw = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["word_cts"])
    raw_tokens = documents.agg(F.coalesce(F.sum(raw), F.lit(0.0))).first()[0]
    return Perplexity(bound, topic_bound(model).total, tokens, raw_tokens)
