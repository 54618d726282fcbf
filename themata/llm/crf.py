"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a distribution over languages. Its features are prefixes and suffixes,
letter n-grams, and the languages in whose lexicon it is frequent; learned transitions tie neighbouring
words together, so a word that fits two languages follows its surroundings, and a text that switches
language switches where the evidence does. Probabilities come from the forward-backward recursions.

The model is fitted on a bounded sample: ``SAMPLE_TEXTS`` labelled texts, ``LANGUAGE_TEXTS`` of one language
at most, chosen by a hash of their content, and of each a run of ``SAMPLE_WORDS`` words. Training sequences alternate runs of
different languages, which is what teaches the transitions. The fit runs on the driver, and the
weights (``FEATURES`` rows) go to the tasks. Prediction reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.llm.common import column, crc_fold, release_memory, slices, text_of
from themata.llm.encoding import forget_encoders

FEATURES = 1 << 16
SAMPLE_TEXTS, LANGUAGE_TEXTS = 1600, 400
SAMPLE_WORDS = 100
#: Words of one language before a training sequence may switch.
RUN_WORDS = 12
LEXICON_WORDS = 300
EPOCHS = 60
RATE, PENALTY = 0.5, 1e-6
#: Marginals that the fit holds at once.
FIT_VALUES = 1 << 21
MAX_LANGUAGES = 256
UNKNOWN = "und"
FOLDS, TEST_FOLD = 3, 1
CACHED_WORDS = 300_000
KNOWN_FEATURES = 200_000
#: Texts and words that take their steps together; more of them need fewer steps.
BATCH_TEXTS, BATCH_WORDS = 2048, 700_000
#: The same beside whole rows that are read and written.
SMALL_SLICE_CHARS, SMALL_BATCH_WORDS = 1_500_000, 250_000

WORDS = re.compile(r"[^\W\d_]+")
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, switches long"


def words_in(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = WORDS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    # The pattern also takes letter-like numbers: fractions, superscripts, Roman numerals.
    return [run for w in words for run in "".join(c if c.isalpha() else " " for c in w).split()]


class FeatureNumbers(dict):
    """Hashed numbers of feature names; those of the first ones asked for are remembered."""

    def __missing__(self, name: str) -> int:
        from xxhash import xxh32_intdigest

        number = xxh32_intdigest(name) % (FEATURES - 1)
        if len(self) < KNOWN_FEATURES:
            self[name] = number
        return number


NUMBERS = FeatureNumbers()


def features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Hashed features of a word: affixes, letter n-grams, lexicon, and one that all words have."""
    marked = f"^{word}$"
    found = {"p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:]}
    found.update(map("g".__add__, map("".join, zip(marked, marked[1:], strict=False))))
    found.update(map("h".__add__, map("".join, zip(marked, marked[1:], marked[2:], strict=False))))
    if word in lexicons:
        found |= {f"w{word}", f"l{lexicons[word]}"}
    numbers = list(map(NUMBERS.__getitem__, found))
    numbers.append(FEATURES - 1)
    return numbers


def forward_backward(
    emission: np.ndarray, starts: np.ndarray, sizes: np.ndarray, transition: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all words, the expected transitions, and the log normaliser of each sequence.

    ``emission`` (words, labels) holds the sequences one behind another. All sequences take a step
    together; those that have ended drop out. Inside, rows are ordered by step, then by falling length
    of the sequence, so that a step is a slice.
    """
    labels, count = emission.shape[1], len(sizes)
    order = np.argsort(-sizes, kind="stable")
    long = sizes[order]
    # How many sequences reach each step, and where its rows begin.
    active = np.searchsorted(-long, -np.arange(long[0] if count else 0), "left")
    first = np.cumsum(active) - active
    which = np.repeat(np.arange(count), long)
    at = np.arange(len(which)) - np.repeat(np.cumsum(long) - long, long)
    source = np.empty(len(which), np.int64)
    source[first[at] + which] = starts[order][which] + at
    local = emission[source]
    top = local.max(1)
    local -= top[:, None]
    np.exp(local, out=local)
    step = np.exp(transition)
    back = np.ascontiguousarray(step.T)
    forward = np.empty_like(local)
    scale = np.empty(len(local))
    alpha = np.full((count, labels), 1.0 / labels)
    for t, (a, n) in enumerate(zip(first.tolist(), active.tolist(), strict=True)):
        alpha = (alpha[:n] @ step if t else alpha) * local[a : a + n]
        total = alpha.sum(1)
        alpha /= total[:, None]
        forward[a : a + n], scale[a : a + n] = alpha, total
    # Forward values of a step are not needed once its marginals are there.
    marginal = forward
    local /= scale[:, None]
    pairs = np.zeros((labels, labels))
    beta = np.ones((count, labels))
    for t in range(len(active) - 1, 0, -1):
        a, n, before = first[t], active[t], first[t - 1]
        ahead = local[a : a + n] * beta[:n]
        pairs += forward[before : before + n].T @ ahead
        beta[:n] = ahead @ back
        marginal[before : before + n] *= beta[:n]
    marginal /= marginal.sum(1, keepdims=True)
    out = local
    out[source] = marginal
    logs = np.empty(count)
    owner = np.empty(len(which), np.int64)
    owner[first[at] + which] = which
    logs[order] = np.bincount(owner, np.log(scale) + top, count)
    return out, pairs * step, logs


class Tagger:
    """A fitted model: languages, lexicon, feature weights and transitions."""

    def __init__(self, languages: list[str], lexicons: dict[str, int], weights: np.ndarray, transition: np.ndarray) -> None:
        self.languages, self.lexicons = languages, lexicons
        self.weights, self.transition = weights, transition
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, len(languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words by language; those of distinct words are kept for the next texts."""
        rows = self.rows
        if len(rows) > CACHED_WORDS:
            rows.clear()
        new = set(words).difference(rows)
        while len(rows) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        if new:
            found = [features(word, self.lexicons) for word in new]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
            scores = np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts)
            self.table[len(rows) : len(rows) + len(new)] = scores
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
        return self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    def word_marginals(self, texts: list[list[str]], most: int = BATCH_WORDS) -> Iterator[np.ndarray]:
        """Distributions over languages for the words of each text, a bounded number at once."""
        if not self.languages:
            # Nothing was learned: no word has a distribution.
            yield from (np.empty((0, 0)) for _ in texts)
            return
        first = 0
        while first < len(texts):
            last, held = first, 0
            while last < len(texts) and (last == first or held + len(texts[last]) <= most):
                held += len(texts[last])
                last += 1
            part = texts[first:last]
            sizes = np.array([len(t) for t in part])
            starts = np.cumsum(sizes) - sizes
            some = sizes > 0
            marginal = np.empty((0, len(self.languages)))
            if some.any():
                emission = self.emissions([w for t in part for w in t])
                marginal = forward_backward(emission, starts[some], sizes[some], self.transition)[0]
            for a, n in zip(starts, sizes, strict=True):
                yield marginal[a : a + n]
            first = last

    def forget(self) -> None:
        """Let go of the words met so far."""
        self.rows.clear()
        self.table = np.empty((1024, len(self.languages)))
        NUMBERS.clear()

    def label(self, text: str) -> list[tuple[str, str]]:
        """The words of a code-switched text with their most probable languages."""
        words = words_in(text)
        marginal = next(self.word_marginals([words]))
        return [(w, self.languages[k]) for w, k in zip(words, marginal.argmax(1), strict=True)]


def word_scores(weights: np.ndarray, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of feature weights by word, one label at a time."""
    columns = [np.add.reduceat(np.ascontiguousarray(weights[:, j])[feature], bounds) for j in range(weights.shape[1])]
    return np.stack(columns, 1)


def fit(samples: list[tuple[str, list[str]]]) -> Tagger:
    """Fit a model to (language, words) runs."""
    languages = sorted({lang for lang, _ in samples})
    index = {lang: k for k, lang in enumerate(languages)}
    counts: dict[str, Counter] = {lang: Counter() for lang in languages}
    for lang, words in samples:
        counts[lang].update(words)
    lexicons: dict[str, int] = {}
    for lang in languages:
        for word, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            lexicons[word] = lexicons.get(word, 0) | (1 << index[lang])
    # Sequences that switch between languages: runs are dealt in an order that mixes them.
    runs = [
        (index[lang], words[i : i + RUN_WORDS]) for lang, words in samples for i in range(0, len(words), RUN_WORDS)
    ]
    mixed = np.random.default_rng(0).permutation(len(runs))
    words = [w for r in mixed for w in runs[r][1]]
    truth = np.array([runs[r][0] for r in mixed for _ in runs[r][1]], np.int64)
    length = SAMPLE_WORDS
    starts = np.arange(0, len(words), length)
    sizes = np.diff(np.append(starts, len(words)))
    vocabulary = sorted(set(words))
    number = {w: i for i, w in enumerate(vocabulary)}
    of = np.array([number[w] for w in words], np.int64)
    rows = [features(w, lexicons) for w in vocabulary]
    feature = np.concatenate([np.array(r) for r in rows]) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    k = len(languages)
    weights, transition = np.zeros((FEATURES, k)), np.zeros((k, k))
    square_w, square_t = np.full((FEATURES, k), 1e-8), np.full((k, k), 1e-8)
    within = np.ones(len(words), bool)
    within[starts] = False
    at = np.flatnonzero(within)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[at - 1], truth[at]), 1)
    bounds = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if owner.size else owner
    for _ in range(EPOCHS if k > 1 else 0):
        by_word = word_scores(weights, feature, bounds)
        per_word, pairs = np.zeros((len(vocabulary), k)), np.zeros((k, k))
        # A bounded number of sequences at once, whatever the number of languages.
        for first in range(0, len(starts), max(1, FIT_VALUES // (length * k))):
            part = slice(first, first + max(1, FIT_VALUES // (length * k)))
            a, b = starts[part][0], starts[part][-1] + sizes[part][-1]
            marginal, seen_here, _ = forward_backward(by_word[of[a:b]], starts[part] - a, sizes[part], transition)
            pairs += seen_here
            marginal[np.arange(b - a), truth[a:b]] -= 1
            for j in range(k):
                per_word[:, j] -= np.bincount(of[a:b], marginal[:, j], len(vocabulary))
        gradient = np.stack([np.bincount(feature, per_word[owner, j], FEATURES) for j in range(k)], 1)
        gradient -= PENALTY * len(words) * weights
        square_w += gradient**2
        weights += RATE * gradient / np.sqrt(square_w)
        change = seen - pairs
        square_t += change**2
        transition += RATE * change / np.sqrt(square_t)
    return Tagger(languages, lexicons, weights, transition)


def free_worker() -> None:
    """Encoded words that a run before left in this worker are of no use here."""
    forget_encoders()
    release_memory()


def sample(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """Labelled runs of words from ``docs`` (text, lang): bounded, and a function of the contents.

    A text's hash decides whether it is taken, once for all its copies; the share taken falls with the
    number of a language's distinct texts, so that about equally many of each come, whatever the size of the
    corpus: ``SAMPLE_TEXTS`` in all, and not more than ``LANGUAGE_TEXTS`` of a language. Only these are sent to the driver, each cut to a run of words that starts at a place given by its hash. Only the
    ``MAX_LANGUAGES`` languages of the most distinct texts are learned; others are never predicted.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    texts = labelled.select("lang", F.xxhash64("text").alias("hash")).distinct()
    totals = texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    # One row per language, at most MAX_LANGUAGES.
    counted = [(r["lang"], r["n"]) for r in totals.collect()]
    each = min(LANGUAGE_TEXTS, SAMPLE_TEXTS / max(1, len(counted)))
    shares = docs.sparkSession.createDataFrame([(lang, each / n) for lang, n in counted], "lang string, share double")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh32_intdigest

        free_worker()
        for batch in batches:
            langs, runs = [], []
            for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
                words = words_in(text)
                first = xxh32_intdigest(text) % max(1, len(words) - SAMPLE_WORDS + 1)
                langs.append(lang)
                runs.append(words[first : first + SAMPLE_WORDS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(runs, pa.list_(pa.string()))], names=["lang", "words"]
            )

    rows = chosen.mapInArrow(cut, "lang string, words array<string>")
    # Copies of one text share a hash, so one hot text could come many times: equal runs count once.
    found = rows.distinct().orderBy(F.xxhash64("words"), "lang").limit(2 * SAMPLE_TEXTS).collect()
    return sorted((r["lang"], list(r["words"])) for r in found if r["words"])


def keep_identified(docs: DataFrame, tagger: Tagger, least: float) -> DataFrame:
    """The rows of ``docs`` with a language of at least this score; letterless and null texts go.

    All columns stay; repeated rows are judged one by one, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        tagger = shared.value
        for batch in slices(batches, "text", BATCH_TEXTS, SMALL_SLICE_CHARS):
            texts = [words_in(t or "") for t in column(batch, "text")]
            kept = [len(m) > 0 and m.mean(0).max() >= least for m in tagger.word_marginals(texts, SMALL_BATCH_WORDS)]
            yield batch.filter(pa.array(kept, pa.bool_()))
        # Other stages use the same worker.
        tagger.forget()
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame) -> Tagger:
    """Fit a model to the labelled documents outside the test fold of ``docs`` (doc_id, text, lang).

    Null texts and languages are left out, copies of a text count once, other columns are ignored. From
    an empty table nothing is learned.
    """
    return fit(sample(docs.where(crc_fold("doc_id", FOLDS) != TEST_FOLD).select("text", F.col("lang").cast("string"))))


def predict(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The language of each whole text of ``docs`` (doc_id, held_out, text).

    ``lang_pred`` is the language with the largest mean word probability and ``score`` that mean;
    ``switches`` counts neighbouring words of different most probable languages. Null and letterless
    texts are ``und`` with score 0, and so are all texts if nothing could be learned.
    """
    # At most FEATURES weights for each of MAX_LANGUAGES languages.
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in slices(batches, "text", BATCH_TEXTS):
            texts = [words_in(t) for t in column(batch, "text")]
            langs, scores, switches = [], [], []
            for marginal in tagger.word_marginals(texts):
                if not len(marginal):
                    langs.append(UNKNOWN), scores.append(0.0), switches.append(0)
                    continue
                mean, best = marginal.mean(0), marginal.argmax(1)
                langs.append(tagger.languages[int(mean.argmax())])
                scores.append(float(min(1.0, mean.max())))
                switches.append(int((best[1:] != best[:-1]).sum()))
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            yield pa.RecordBatch.from_arrays(
                [get("doc_id"), get("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "switches"],
            )

    return docs.select("doc_id", "held_out", text_of().alias("text")).mapInArrow(run, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents outside the test fold of ``docs`` (doc_id, text, lang), and
    predict all of them.

    The fold is the remainder of the crc32 of doc_id written as text (null: the empty text). Only
    text and lang are learned from, and only text is predicted from. Repeated rows are predicted one
    by one; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_fold("doc_id", FOLDS) == TEST_FOLD).alias("held_out"),
        F.col("text"),
    )
    return predict(rows, learn(docs))
