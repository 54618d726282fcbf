"""Plain one-document-at-a-time versions of the numerical steps, for comparison."""

from __future__ import annotations

import numpy as np

from themata.functions.special import digamma, dirichlet_expectation, lgamma


def infer(ids, counts, lam, lambda_sum, alpha, gamma, threshold=0.001, max_steps=100):
    """gamma, the statistics by word, and the bound after every step."""
    log_beta = digamma(np.asarray([lam[w] for w in ids])) - digamma(lambda_sum)
    beta, counts = np.exp(log_beta), np.asarray(counts, dtype=float)
    gamma = np.array(gamma, dtype=float)
    theta = np.exp(dirichlet_expectation(gamma))
    bounds = []
    for _ in range(max_steps):
        last = gamma
        gamma = theta * (beta.T @ (counts / (beta @ theta + 1e-100))) + alpha
        theta = np.exp(dirichlet_expectation(gamma))
        bounds.append(bound(log_beta, counts, gamma, alpha))
        if np.abs(gamma - last).mean() < threshold:
            break
    stats = theta * (counts / (beta @ theta + 1e-100))[:, None] * beta
    return gamma, stats, bounds


def bound(log_beta, counts, gamma, alpha):
    log_theta = dirichlet_expectation(gamma)
    x = log_beta + log_theta
    top = x.max(axis=1)
    words = counts @ (top + np.log(np.exp(x - top[:, None]).sum(axis=1)))
    rest = ((alpha - gamma) * log_theta + lgamma(gamma) - lgamma(alpha)).sum()
    return words + rest + lgamma(alpha.sum()) - lgamma(gamma.sum())
