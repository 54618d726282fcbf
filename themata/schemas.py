"""Column layouts shared by all modules, as DDL."""

# Documents as bags of words, one row per document.
CORPUS = "doc_id BIGINT, word_ids ARRAY<BIGINT>, word_cts ARRAY<DOUBLE>"
# The same as one row per (document, word).
BOW = "doc_id BIGINT, word_id BIGINT, cnt DOUBLE"
# Encoded documents as they are kept in storage.
CELLS = "doc_id BIGINT, doc STRING"
VOCABULARY = "word STRING, word_id BIGINT, tf BIGINT, df BIGINT"
# Topic-word table.
LAMBDA = "word_id BIGINT, lambda ARRAY<DOUBLE>"
# Sufficient statistics by word.
STATS = "word_id BIGINT, s ARRAY<DOUBLE>"
# Result of the E-step by document.
DOC_GAMMA = "doc_id BIGINT, gamma ARRAY<DOUBLE>, bound DOUBLE, tokens DOUBLE, steps INT"
DOC_TOPIC = "doc_id BIGINT, topic_idx ARRAY<INT>, prob ARRAY<DOUBLE>"
DOC_WORD = "doc_id BIGINT, word_ids ARRAY<BIGINT>, probs ARRAY<DOUBLE>"
MODEL_META = (
    "alpha ARRAY<DOUBLE>, eta DOUBLE, num_updates INT, num_topics INT, "
    "total_docs BIGINT, num_words BIGINT, lambda_sum ARRAY<DOUBLE>, "
    "buckets INT"
)
METRICS = "iter INT, metric STRING, value DOUBLE"
