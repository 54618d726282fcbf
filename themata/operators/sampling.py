"""Mini-batches and held-out documents, drawn by key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.functions.draws import poisson_thresholds, uniform_col
from themata.functions.vectors import against
from themata.storage import drop_table, new_folder, spread

# Documents of a batch that one file, and so one task, holds at least and at most, about.
DOCS_PER_TASK = 32
MOST_DOCS_PER_TASK = 1 << 15


def lanes_of(docs: float, cores: int) -> int:
    """Files of a batch of so many documents."""
    few = min(cores, math.ceil(docs / DOCS_PER_TASK))
    return max(1, few, math.ceil(docs / MOST_DOCS_PER_TASK))


def draw_minibatches(
    corpus: DataFrame, fraction: float, seed: int, first: int, last: int
) -> DataFrame:
    """The batches of iterations ``first .. last``, told apart by ``iteration``.

    Each one draws documents with replacement: a Poisson number ``draws`` of every
    document. The number depends on the seed, the iteration and the document id
    alone, so a recomputed task draws the same batch. A document drawn m times
    stays one row with its counts times m.
    """
    steps = poisson_thresholds(fraction)
    doc = F.col("doc_id")
    # P(draws > 0) is small for most batches: only drawn rows go on.
    drawn = F.filter(
        F.sequence(F.lit(first), F.lit(last)),
        lambda i: uniform_col(seed, i, doc) >= F.lit(steps[0]),
    )
    passed = against(
        F.array(*[F.lit(t) for t in steps]),
        uniform_col(seed, F.col("iteration"), doc),
        lambda t, u: (u >= t).cast("int"),
    )
    return (
        corpus.withColumn("iteration", F.explode(drawn))
        .withColumn("draws", F.aggregate(passed, F.lit(0), lambda a, b: a + b))
        .withColumn("word_cts", against(F.col("word_cts"), F.col("draws"), lambda c, m: c * m))
    )


def draw_minibatch(corpus: DataFrame, fraction: float, seed: int, iteration: int) -> DataFrame:
    """The batch of one iteration."""
    batch = draw_minibatches(corpus, fraction, seed, iteration, iteration)
    return batch.drop("iteration")


class BatchWindow:
    """The batches of several iterations, drawn in one scan of the corpus.

    They are written to a table by iteration, so an iteration reads its own batch
    and not the corpus. All batches of a window together are about as large as the
    corpus at most.
    """

    def __init__(
        self, corpus: DataFrame, fraction: float, seed: int, first: int, last: int, docs: int
    ):
        self.spark = corpus.sparkSession
        self.path = new_folder(self.spark, "batches")
        self.last = last
        cores = self.spark.sparkContext.defaultParallelism
        lanes = lanes_of(docs * fraction, cores)
        tasks = max(lanes, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        batches = draw_minibatches(
            corpus.select("doc_id", "word_ids", "word_cts"), fraction, seed, first, last
        )
        self.schema = batches.schema
        # The lanes of an iteration are different tasks, so a batch has a file for each of them.
        lane = F.pmod(F.xxhash64("doc_id"), F.lit(lanes))
        task = F.pmod(lane + F.col("iteration") * F.lit(lanes), F.lit(tasks)).cast("int")
        (
            batches.withColumn("_task", task)
            .repartitionById(tasks, "_task")
            .drop("_task")
            .write.partitionBy("iteration")
            .parquet(self.path)
        )
        sizes = self._table().groupBy("iteration").agg(F.sum("draws").alias("n")).collect()
        # Drawn documents by iteration, one number each.
        self.docs = {row["iteration"]: row["n"] for row in sizes}

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @staticmethod
    def size(fraction: float, most: int) -> int:
        """Iterations of a window."""
        return max(1, min(most, int(1.0 / fraction)))

    def batch(self, iteration: int) -> DataFrame:
        return self._table().where(F.col("iteration") == iteration).drop("iteration")

    def drop(self) -> None:
        drop_table(self.spark, self.path)


class DirectBatches:
    """Batches that are a large share of the corpus: each is drawn while the corpus is read.

    Nothing is written. Only the numbers of draws are counted beforehand, for all
    iterations in one scan of the document ids.
    """

    #: From this fraction on, reading the corpus costs less than writing and reading a window.
    LEAST_FRACTION = 1 / 8

    def __init__(self, corpus: DataFrame, fraction: float, seed: int, first: int, last: int):
        self.corpus = corpus.select("doc_id", "word_ids", "word_cts")
        self.fraction, self.seed, self.last = fraction, seed, last
        # Of a corpus in a few small files, the drawn documents are spread over all cores.
        few = spread(self.corpus) is not self.corpus
        self.tasks = corpus.sparkSession.sparkContext.defaultParallelism if few else 0
        bare = corpus.select("doc_id", F.array().cast("array<double>").alias("word_cts"))
        drawn = draw_minibatches(bare, fraction, seed, first, last)
        sizes = drawn.groupBy("iteration").agg(F.sum("draws").alias("n")).collect()
        self.docs = {row["iteration"]: row["n"] for row in sizes}

    def batch(self, iteration: int) -> DataFrame:
        batch = draw_minibatch(self.corpus, self.fraction, self.seed, iteration)
        return batch.repartition(self.tasks) if self.tasks else batch

    def drop(self) -> None:
        """Nothing was written."""


def batch_size(batch: DataFrame) -> DataFrame:
    """``(documents, batch_size, tokens)``: different documents of a batch, draws, and drawn tokens."""
    tokens = F.aggregate("word_cts", F.lit(0.0), lambda a, b: a + b)
    return batch.agg(
        F.count("*").alias("documents"),
        F.sum("draws").alias("batch_size"),
        F.sum(tokens).alias("tokens"),
    )


def batch_words(batch: DataFrame) -> DataFrame:
    """``(word_id)``: the different words of a batch."""
    return batch.select(F.explode("word_ids").alias("word_id")).distinct()


def count_words(batch: DataFrame, low: int) -> DataFrame:
    """``(words, modelled)``: different words of a batch, and those whose id is at least ``low``."""
    return batch_words(batch).agg(
        F.count("*").alias("words"),
        F.count(F.when(F.col("word_id") >= low, 1)).alias("modelled"),
    )


def heldout_draw(corpus: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` documents that come first in a seeded random order of the ids."""
    u = uniform_col(seed, F.lit(0), F.col("doc_id"))
    return corpus.withColumn("_u", u).orderBy("_u", "doc_id").limit(n).drop("_u")


def training_part(corpus: DataFrame, heldout: DataFrame) -> DataFrame:
    """The documents that are not held out."""
    return corpus.join(heldout.select("doc_id"), "doc_id", "left_anti")
