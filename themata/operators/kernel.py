"""The variational update of documents, in NumPy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np

from themata.functions.draws import gamma_draws
from themata.functions.special import digamma, dirichlet_expectation, lgamma

# Fixed value: keeps the normaliser of a word away from zero.
TINY = 1e-100
# Documents are updated together as long as their word rows stay in cache.
TILE_VALUES = 1 << 18
# Settled documents leave the arrays of a tile once they are one in so many.
SETTLED_SHARE = 8
# Documents whose tiles are regrouped together: this many values of gamma, about.
POOL_VALUES = 1 << 22


@dataclass(frozen=True)
class InferenceSpec:
    """What a task needs besides documents and topic-word rows."""

    alpha: np.ndarray
    lambda_sum: np.ndarray
    threshold: float
    # Steps after which a document is left as it is; None lets the stop rule end all.
    max_steps: int | None
    seed: int = 0
    iteration: int = 0
    gamma_start: str = "gamma"

    @property
    def num_topics(self) -> int:
        return len(self.alpha)

    def steps(self) -> Iterable[int]:
        """The numbers of the steps, from 1."""
        return count(1) if self.max_steps is None else range(1, self.max_steps + 1)

    def start(self, doc_ids: np.ndarray) -> np.ndarray:
        if self.gamma_start == "ones":
            return np.ones((len(doc_ids), self.num_topics))
        return gamma_draws(doc_ids, self.num_topics, self.seed, self.iteration)


class WordRows:
    """Rows of E[log beta] and their exponentials, looked up by word id."""

    def __init__(self, word_ids: np.ndarray, log_beta: np.ndarray):
        if (np.diff(word_ids) <= 0).any():
            order = np.argsort(word_ids, kind="stable")
            word_ids, log_beta = word_ids[order], log_beta[order]
        self.word_ids = word_ids
        self.log_beta = log_beta
        self.beta = np.exp(log_beta)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for a word that is not in the model."""
        if not len(self.word_ids):
            return np.full(len(ids), -1)
        at = np.searchsorted(self.word_ids, ids)
        at[at == len(self.word_ids)] = 0
        return np.where(self.word_ids[at] == ids, at, -1)


class TableRows(WordRows):
    """The same for a whole table of sorted rows, of which a task needs those of its own words."""

    def __init__(self, word_ids: np.ndarray, lam: np.ndarray, log_sums: np.ndarray):
        self.word_ids, self.lam, self.log_sums = word_ids, lam, log_sums
        # Rows that are not needed are not written, so they take no memory.
        self.log_beta, self.beta = np.empty_like(lam), np.empty_like(lam)
        self.ready = np.zeros(len(word_ids), dtype=bool)

    def find(self, ids: np.ndarray) -> np.ndarray:
        rows = super().find(ids)
        new = np.zeros(len(self.word_ids) + 1, dtype=bool)
        new[rows] = True
        new = np.flatnonzero(new[:-1] & ~self.ready)
        self.log_beta[new] = digamma(self.lam[new]) - self.log_sums
        self.beta[new] = np.exp(self.log_beta[new])
        self.ready[new] = True
        return rows


@dataclass
class Documents:
    """Documents with at least one modelled word: flat words with document starts."""

    doc_ids: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, doc_ids, offsets, ids, counts, words: WordRows) -> Documents:
        rows = words.find(ids)
        known = rows >= 0
        size = np.add.reduceat(np.r_[known, False].astype(np.int64), offsets[:-1])
        size[offsets[:-1] == offsets[1:]] = 0
        present = size > 0
        starts = np.r_[0, np.cumsum(size[present])]
        return cls(doc_ids[present], starts, rows[known], counts[known])

    def tiles(self, members: np.ndarray, num_topics: int) -> Iterator[np.ndarray]:
        """Groups of the given documents of similar length whose word rows fill about one tile."""
        size = self.starts[members + 1] - self.starts[members]
        order = np.argsort(size, kind="stable")
        ordered, members = size[order], members[order]
        lo = 0
        while lo < len(members):
            # Padded to the longest, the last one, the group has n * length rows.
            most = max(1, TILE_VALUES // int(ordered[lo] * num_topics))
            near = ordered[lo : lo + most]
            fits = np.arange(1, len(near) + 1) * near * num_topics <= TILE_VALUES
            hi = lo + max(1, int(np.count_nonzero(fits)))
            yield members[lo:hi]
            lo = hi


@dataclass
class Tile:
    """Documents side by side; shorter ones are padded with words of count zero."""

    doc_ids: np.ndarray
    rows: np.ndarray
    counts: np.ndarray
    used: np.ndarray

    @classmethod
    def of(cls, docs: Documents, members: np.ndarray) -> Tile:
        size = docs.starts[members + 1] - docs.starts[members]
        place = np.arange(size.max())[None, :]
        used = place < size[:, None]
        at = np.where(used, docs.starts[members][:, None] + place, 0)
        return cls(
            docs.doc_ids[members], docs.rows[at], np.where(used, docs.counts[at], 0.0), used
        )


@dataclass
class TileResult:
    gamma: np.ndarray
    theta: np.ndarray
    steps: np.ndarray

    def of(self, at: np.ndarray) -> TileResult:
        return TileResult(self.gamma[at], self.theta[at], self.steps[at])


def word_norms(beta: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return np.matmul(beta, theta[:, :, None])[:, :, 0] + TINY


def infer(
    docs: Documents, words: WordRows, spec: InferenceSpec
) -> Iterator[tuple[Tile, TileResult]]:
    """Update gamma of all documents until each has settled, tile by tile."""
    step = max(1, POOL_VALUES // spec.num_topics)
    for first in range(0, len(docs.doc_ids), step):
        members = np.arange(first, min(first + step, len(docs.doc_ids)))
        yield from _infer_pool(docs, members, words, spec)


def _infer_pool(
    docs: Documents, members: np.ndarray, words: WordRows, spec: InferenceSpec
) -> Iterator[tuple[Tile, TileResult]]:
    """Documents take very different numbers of steps. A tile is left once half of its documents have
    settled, and the others of all tiles form new ones, so a step is always one of a full tile as
    long as enough documents are open."""
    first = members[0]
    gamma = spec.start(docs.doc_ids[members])
    res = TileResult(gamma, np.exp(dirichlet_expectation(gamma)), np.zeros(len(gamma), np.int32))
    unsettled = members
    while len(unsettled):
        left = []
        for at in docs.tiles(unsettled, spec.num_topics):
            open_ = _advance(Tile.of(docs, at), res, at - first, words, spec)
            left.append(at[open_])
        unsettled = np.concatenate(left)
    for at in docs.tiles(members, spec.num_topics):
        yield Tile.of(docs, at), res.of(at - first)


def _advance(
    tile: Tile, res: TileResult, at: np.ndarray, words: WordRows, spec: InferenceSpec
) -> np.ndarray:
    """Steps of the documents ``at`` until half of them have settled: which ones have not."""
    # Words are the last axis, so that products run along them whatever the number of topics.
    beta, counts = np.ascontiguousarray(words.beta[tile.rows].transpose(0, 2, 1)), tile.counts
    gamma, theta, steps = res.gamma[at], res.theta[at], res.steps[at]
    held, going = np.arange(len(at)), np.ones(len(at), dtype=bool)
    while True:
        ratio = np.matmul(theta[:, None, :], beta)[:, 0, :]
        ratio += TINY
        np.divide(counts, ratio, out=ratio)
        weight = np.matmul(beta, ratio[:, :, None])[:, :, 0]
        # Settled documents stay as they are.
        new = theta * weight + spec.alpha
        if not np.isfinite(new[going]).all():
            bad = tile.doc_ids[held[going & ~np.isfinite(new).all(axis=1)]][0]
            raise FloatingPointError(
                f"gamma is not finite in document {bad}; check lambda, alpha and its counts"
            )
        moved = np.abs(new - gamma).mean(axis=1)
        if going.all():
            gamma, theta = new, np.exp(dirichlet_expectation(new))
        else:
            gamma[going] = new[going]
            theta[going] = np.exp(dirichlet_expectation(new[going]))
        steps += going
        going &= moved >= spec.threshold
        if spec.max_steps is not None:
            going &= steps < spec.max_steps
        open_ = np.count_nonzero(going)
        last = 2 * open_ <= len(at)
        if last or SETTLED_SHARE * (len(going) - open_) >= len(going):
            here = at[held]
            res.gamma[here], res.theta[here], res.steps[here] = gamma, theta, steps
            held = held[going]
            if last:
                break
            beta, counts = beta[going], counts[going]
            gamma, theta, steps = gamma[going], theta[going], steps[going]
            going = np.ones(open_, dtype=bool)
    left = np.zeros(len(at), dtype=bool)
    left[held] = True
    return left


def tile_statistics(tile: Tile, words: WordRows, res: TileResult):
    """Sums of theta * (count / phi) * beta by word row: ``(rows, sums)``."""
    beta = words.beta[tile.rows]
    ratio = tile.counts / word_norms(beta, res.theta)
    beta *= ratio[:, :, None] * res.theta[:, None, :]
    rows, values = tile.rows[tile.used], beta[tile.used]
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def tile_bounds(tile: Tile, words: WordRows, res: TileResult, alpha: np.ndarray):
    """The part of the variational bound that belongs to each document, and its tokens."""
    log_theta = dirichlet_expectation(res.gamma)
    bound = ((alpha - res.gamma) * log_theta + lgamma(res.gamma) - lgamma(alpha)).sum(axis=1)
    bound += lgamma(alpha.sum()) - lgamma(res.gamma.sum(axis=1))
    x = words.log_beta[tile.rows] + log_theta[:, None, :]
    top = x.max(axis=2)
    log_phi = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
    return bound + (tile.counts * log_phi).sum(axis=1), tile.counts.sum(axis=1)
