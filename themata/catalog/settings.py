"""The settings of the registered queries, used by both sides."""

from __future__ import annotations

TOPICS = 4
ALPHA = 0.25
ETA = 0.125
DECAY = 1024.0
LEARNING_RATE = 0.7
INNER_STEPS = 2
SEED = 7
FRACTION = 0.5
HELDOUT_DOCS = 100
LOWEST_WORD = 100
BATCH_SIZE = 50
TRAIN_ITERATIONS = 2
ALPHA_WEIGHT = 0.5
# Topics whose words a task may hold in the threshold search.
SEARCH_TOPICS = 3
# Words in a part of a document's joined rows.
ROWS_IN_PART = 64
# Words that a job may store at once, and files of a slice of documents.
WORDS_STORED = 1 << 24
SLICE_FILES = 16
# The stop rule, and a run with the usual settings.
THRESHOLD = 0.001
MOST_STEPS = 100
FAST_DECAY = 8.0

# Start table of the queries: lambda = 1 + ((31 word + 17 topic + frequency) mod 97) / 128, with the
# frequency of the word in the documents. The values are dyadic, so their sums are exact in any order.
WORD_FACTOR, TOPIC_FACTOR, MODULUS, SCALE = 31, 17, 97, 128
