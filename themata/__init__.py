"""Online topic modelling on Spark DataFrames.

The topic-word matrix is a table with one row per word, documents are rows of
``(doc_id, word_ids, word_cts)``, and training, evaluation and scoring are jobs
over those tables.
"""

from themata.params import TopicParams
from themata.plans.score import score_topics, score_words
from themata.plans.train import resume_training, train

__all__ = ["TopicParams", "resume_training", "score_topics", "score_words", "train"]
