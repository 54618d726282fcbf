"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at one property of a text and votes good, bad or not at all. What a rule's votes are
worth is not given but estimated: for good and for bad texts, each rule has its own shares of good
votes, bad votes and abstentions, and these and the share of good texts are found by
expectation-maximisation over all texts that pass the base rules. The posterior probability of a good text replaces passing
all rules. A text's votes are one of 3^rules patterns, so the estimation runs on a table of patterns
with their counts, which does not grow with the corpus.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.llm.common import release_memory, text_of, words_of
from themata.storage import materialise

# Characters that mark symbols, and frequent function words of four languages.
SYMBOLS = "#*$%&|<>"
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on are as with be at by this from or an not which "
    "der die das und ist von zu den mit ein eine nicht auf für sich dem des im auch es "
    "le la les de et un une des du en que est pour qui dans par sur au pas avec "
    "el los las y que del se un una por con para no su al lo como más".split()
)

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Rules: property, the range in which it votes good, the range in which it votes bad.
RULES: list[tuple[str, tuple[float, float], tuple[float, float]]] = [
    ("words", (20, float("inf")), (0, MIN_WORDS - 1)),
    ("symbol_share", (0, 0.01), (0.05, float("inf"))),
    ("repeat_share", (0, 0.05), (0.2, float("inf"))),
    ("line_repeat_share", (0, 0.05), (0.3, float("inf"))),
    ("upper_share", (0, 0.2), (0.5, float("inf"))),
    ("shout_share", (0, 0.01), (0.1, float("inf"))),
    ("function_share", (0.05, float("inf")), (0, 0.01)),
    ("twin_share", (0, 0.03), (0.2, float("inf"))),
    ("word_length", (3, 10), (15, float("inf"))),
    ("letter_share", (0.8, float("inf")), (0, 0.6)),
]

#: Shorter texts may well have no function word; their share is at least one that gets no vote.
FUNCTION_MIN_WORDS, FUNCTION_ABSTAINS = 30, 0.02

ROUNDS = 200
TOLERANCE = 1e-7
#: Before seeing data: shares of abstaining, good and bad votes. A good text seldom shows a defect; a
#: bad one lacks most of them. Weighed as a share of the corpus, so alike at every size.
GOOD_PRIOR, BAD_PRIOR = (0.19, 0.8, 0.01), (0.15, 0.55, 0.3)
PRIOR_SHARE = 0.02
START_GOOD = 0.8

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes int"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]


def repeated_words(words: list[str]) -> int:
    """How many words lie in five-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(islice(words, k, None) for k in range(WINDOW)), strict=False))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    total = covered = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + WINDOW - max(covered, at)
            covered = at + WINDOW
    return total


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The base counts of a text and its votes, one base-3 digit per rule (1 good, 2 bad)."""
    words = words_of(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return n, chars, symbols, duplicates, repeats, 2
    letters = sum(map(str.isalpha, text))
    functions = sum(map(FUNCTION_WORDS.__contains__, map(str.lower, words))) / n
    if n < FUNCTION_MIN_WORDS:
        functions = max(functions, FUNCTION_ABSTAINS)
    values = (
        n,
        symbols / chars,
        repeats / n,
        duplicates / len(lines),
        sum(map(str.isupper, words)) / n,
        text.count("!!") / n,
        functions,
        sum(map(operator.eq, words, islice(words, 1, None))) / n,
        chars / n,
        letters / chars,
    )
    votes = 0
    for place, (value, (_, good, bad)) in enumerate(zip(values, RULES, strict=True)):
        vote = 1 if good[0] <= value <= good[1] else 2 if bad[0] <= value <= bad[1] else 0
        votes += vote * 3**place
    return n, chars, symbols, duplicates, repeats, votes


def measured_texts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in MEASURES.split(", ")]
    for batch in texts:
        yield pd.DataFrame([measure(t) for t in batch], columns=names)
    release_memory()


def estimate(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior probability of a good text for each pattern of votes."""
    if not len(patterns):
        return np.empty(0)
    votes = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3
    hot = (votes[:, :, None] == np.arange(3)).astype(float)  # pattern, rule, vote
    shares = np.array([GOOD_PRIOR, BAD_PRIOR])
    weight = PRIOR_SHARE * max(counts.sum(), 1)
    model = np.repeat(shares[:, None, :], len(RULES), 1)
    good = START_GOOD
    posterior = np.zeros(len(patterns))
    for _ in range(ROUNDS):
        logs = np.einsum("prv,crv->pc", hot, np.log(model)) + np.log([good, 1 - good])
        logs -= logs.max(1, keepdims=True)
        likely = np.exp(logs)
        now = likely[:, 0] / likely.sum(1)
        moved, posterior = np.abs(now - posterior).max(), now
        if moved < TOLERANCE:
            break
        mass = np.stack([counts * posterior, counts * (1 - posterior)], 1)
        seen = np.einsum("pc,prv->crv", mass, hot) + weight * shares[:, None, :]
        model = seen / seen.sum(2, keepdims=True)
        good = (mass[:, 0].sum() + weight * START_GOOD) / (counts.sum() + weight)
    return posterior


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``quality`` (posterior) and ``kept``.

    Null text is a text without words; such texts fail. Repeated rows are judged one by one. Columns
    of the added names are replaced. All other columns stay. An empty table gives no rows.
    """
    rows = docs.drop(*[c for c in ADDED if c in docs.columns])
    measures = F.pandas_udf(measured_texts, MEASURES)
    # The row stands in a column of its own, so no name of its columns can clash.
    measured = materialise(rows.select(F.struct("*").alias("row"), measures(text_of()).alias("m")), "measured")
    words, repeats = F.col("m.n_words"), F.col("m.n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    counted = measured.groupBy("m.votes").agg(F.sum(F.when(failed, 0).otherwise(1)).alias("n")).toPandas()
    posterior = estimate(counted["votes"].to_numpy(np.int64), counted["n"].to_numpy(np.int64))
    # One row per pattern of votes: at most 3^rules.
    table = docs.sparkSession.createDataFrame(
        [(int(v), float(p)) for v, p in zip(counted["votes"], posterior, strict=True)], "votes int, quality double"
    )
    names = [part.split()[0] for part in MEASURES.split(", ")][:-1]
    judged = measured.join(F.broadcast(table), F.col("m.votes") == F.col("votes"))
    return judged.select(
        *[F.col(f"row.`{c}`") for c in rows.columns],
        "quality",
        failed.alias("base_failed"),
        *[F.col(f"m.{n}").alias(n) for n in names],
        (~failed & (F.col("quality") >= 0.5)).alias("kept"),
    )
