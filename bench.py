"""Times the main jobs on the given tables and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from themata.operators.estep import e_step  # noqa: E402
from themata.operators.topictable import store_rows  # noqa: E402
from themata.operators.topicword import lambda_sums  # noqa: E402
from themata.params import TopicParams  # noqa: E402
from themata.plans.score import score_topics  # noqa: E402
from themata.plans.train import evaluate, inference_spec, new_model, train  # noqa: E402
from themata.operators.distributions import word_distributions  # noqa: E402
from themata.session import ship_package  # noqa: E402
from themata.sources import corpus as C  # noqa: E402
from themata.storage import materialise, new_folder, spread  # noqa: E402

MIN_DF = 5
TRAIN_ITERATIONS = 5
TOPICS = (10, 100)


def library_iteration(corpus: DataFrame, num_words: int, num_topics: int) -> float:
    """Seconds of one iteration of Spark's own online model on the same corpus."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql import functions as F

    to_vector = F.udf(lambda i, c: SparseVector(num_words, i, c), VectorUDT())
    vectors = materialise(corpus.select(to_vector("word_ids", "word_cts").alias("features")), "vectors")
    model = LDA(
        k=num_topics, maxIter=TRAIN_ITERATIONS, optimizer="online", subsamplingRate=0.2, seed=1,
        learningOffset=8.0, learningDecay=0.7, topicConcentration=0.1, optimizeDocConcentration=False,
    )
    began = time.monotonic()
    model.fit(vectors)
    return round((time.monotonic() - began) / TRAIN_ITERATIONS, 3)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def warm_up(corpus: DataFrame, num_words: int) -> None:
    """Start the Python workers and compile the common plans."""
    few = materialise(corpus.limit(64), "warm-up")
    params = TopicParams(
        eta=0.1,
        mini_batch_fraction=0.5,
        vocab_size=num_words,
        num_topics=3,
        total_docs=64,
        max_outer_iter=2,
    )
    model = train(few, params, new_folder(corpus.sparkSession, "model"))
    doc_topic = materialise(score_topics(few, model), "doc-topic")
    run(word_distributions(doc_topic, model))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("themata-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    seconds: dict[str, float] = {}

    def timed(name: str, job, per: int = 1):
        began = time.monotonic()
        result = job()
        seconds[name] = round((time.monotonic() - began) / per, 3)
        return result

    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    run(spread(raw))
    bags = timed("bags_of_words", lambda: materialise(C.bags_of_words(spread(raw)), "bags"))
    vocab = timed("vocabulary", lambda: materialise(C.vocabulary(bags, MIN_DF), "vocabulary"))
    corpus = timed(
        "encode_corpus",
        lambda: materialise(
            C.collect_documents(C.encode_words(C.word_counts(bags), vocab)), "corpus"
        ),
    )
    cells = materialise(C.corpus_to_cells(corpus), "cells")
    timed("decode_cells", lambda: run(C.corpus_from_cells(cells)))

    num_words, num_docs = vocab.count(), corpus.count()
    warm_up(corpus, num_words)
    rates: dict[str, float] = {}
    library: dict[str, float] = {}
    for num_topics in TOPICS:
        tag = f"t{num_topics}"
        params = TopicParams(
            eta=0.1,
            mini_batch_fraction=0.2,
            vocab_size=num_words,
            num_topics=num_topics,
            total_docs=num_docs,
            decay=8.0,
            max_outer_iter=TRAIN_ITERATIONS,
            partitions=int(cpus),
            perplexity=False,
            lambda_start="gamma",
        )
        start = new_model(spark, params, new_folder(spark, "lambda"))
        model = timed(
            f"train_iteration_{tag}",
            lambda: train(corpus, params, new_folder(spark, "model"), model=start),
            TRAIN_ITERATIONS,
        )
        spec = inference_spec(model, params, model.num_updates)
        timed(f"estep_broadcast_{tag}", lambda: run(e_step(corpus, model, spec, "stats")))
        timed(
            f"estep_blocks_{tag}",
            lambda: run(e_step(corpus, model, spec, "stats", broadcast_bytes=1)),
        )
        stats = materialise(e_step(corpus, model, spec, "stats"), "stats")
        rows = store_rows(model.lam, int(cpus), num_topics, new_folder(spark, "rows"))
        timed(
            f"mstep_{tag}",
            lambda: rows.add(stats, 0.1, params.eta, 1.0, new_folder(spark, "mstep")),
        )
        timed(f"lambda_sums_{tag}", lambda: lambda_sums(model.lam))
        timed(f"perplexity_{tag}", lambda: evaluate(corpus, model, params))
        timed(f"score_topics_{tag}", lambda: run(score_topics(corpus, model)))
        doc_topic = materialise(score_topics(corpus, model), "doc-topic")
        timed(f"score_words_{tag}", lambda: run(word_distributions(doc_topic, model)))
        if num_topics == TOPICS[0]:
            # Layouts of tables that are too large to broadcast.
            chunk = 8 * num_topics * num_words // 4
            timed(
                f"score_words_chunks_{tag}",
                lambda: run(word_distributions(doc_topic, model, 1, chunk)),
            )
        library[f"train_iteration_{tag}"] = library_iteration(corpus, num_words, num_topics)
        rates[f"score_topics_{tag}"] = round(num_docs / seconds[f"score_topics_{tag}"], 1)
        rates[f"score_words_{tag}"] = round(num_docs / seconds[f"score_words_{tag}"], 1)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "docs": num_docs,
                "words": num_words,
                "docs_per_second": rates,
                "pyspark_ml_seconds": library,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
