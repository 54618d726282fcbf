"""Training parameters and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class TopicParams:
    eta: float
    mini_batch_fraction: float
    # The default workload.
    vocab_size: int = 171769
    alpha: Sequence[float] = (-1.0,)
    decay: float = 1024.0
    learning_rate: float = 0.7
    max_outer_iter: int = 100000
    # None: inference of a document ends by the threshold alone.
    max_inner_iter: int | None = None
    convergence_threshold: float = 0.001
    num_topics: int = 3000
    total_docs: int = 2193062
    partitions: int = 100
    optimize_doc_concentration: bool = False
    perplexity: bool = True
    init_lambda: bool = True
    perplexity_freq: int = 200
    check_point_freq: int = 5000
    tf_ranking_min: int = 0
    # Start values and reproducibility.
    seed: int = 0
    lambda_start: str = "ones"
    gamma_start: str = "gamma"
    # Iterations whose batches are drawn in one scan of the corpus, at most.
    batches_per_scan: int = 64
    # A topic-word table up to this size is broadcast; beyond it, it is shuffled.
    broadcast_bytes: int = 64 << 20
    # Topic-word rows that one task holds at a time when the table is shuffled.
    block_bytes: int = 256 << 20

    def __post_init__(self) -> None:
        if self.num_topics < 2:
            raise ValueError("num_topics must be at least 2")
        if self.eta <= 0:
            raise ValueError("eta must be above 0")
        if self.mini_batch_fraction <= 0:
            raise ValueError("mini_batch_fraction must be above 0")
        if self.max_inner_iter is not None and self.max_inner_iter < 1:
            raise ValueError("max_inner_iter must be at least 1")
        if self.tf_ranking_min < 0 or self.tf_ranking_min >= self.vocab_size:
            raise ValueError("tf_ranking_min must lie in [0, vocab_size)")
        if self.lambda_start not in ("ones", "gamma"):
            raise ValueError("lambda_start is 'ones' or 'gamma'")
        if self.gamma_start not in ("ones", "gamma"):
            raise ValueError("gamma_start is 'ones' or 'gamma'")
        if self.lambda_start == "ones" and self.gamma_start == "ones":
            raise ValueError("equal start values of lambda and gamma leave all topics equal")
        self.alpha_vector()

    def alpha_vector(self) -> np.ndarray:
        """Document prior by topic: -1 stands for 1/T, one value for a symmetric prior."""
        alpha = np.asarray(self.alpha, dtype=float).ravel()
        if alpha.size == 1:
            value = 1.0 / self.num_topics if alpha[0] == -1 else alpha[0]
            alpha = np.full(self.num_topics, value)
        if alpha.size != self.num_topics:
            raise ValueError(f"alpha needs 1 or {self.num_topics} values, got {alpha.size}")
        if not (alpha > 0).all():
            raise ValueError("all values of alpha must be above 0")
        return alpha

    def step_size(self, iteration: int) -> float:
        return (self.decay + iteration) ** (-self.learning_rate)
