"""Train or continue a topic model.

    spark-submit --py-files themata.zip apps/train.py --corpus ... --model ...
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from common import add_corpus, add_sizes, flag, load_corpus, sizes  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from themata.params import TopicParams  # noqa: E402
from themata.plans.train import new_model, resume_training, train  # noqa: E402
from themata.session import ship_package  # noqa: E402
from themata.sources.corpus import read_corpus  # noqa: E402
from themata.sources.heldout import split_heldout  # noqa: E402
from themata.storage import materialise  # noqa: E402


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    add_corpus(parser)
    parser.add_argument("--model", required=True, help="folder of the saved models")
    held = parser.add_mutually_exclusive_group()
    held.add_argument("--heldout", help="folder of a held-out corpus")
    held.add_argument(
        "--heldout-docs",
        type=int,
        help="documents to draw, to store beside the model and to keep out of training",
    )
    parser.add_argument("--lambda-table", help="stored topic-word table to start from")
    parser.add_argument("--topics", type=int, required=True)
    parser.add_argument("--total-docs", type=int, required=True)
    parser.add_argument("--vocab-size", type=int, required=True)
    parser.add_argument("--mini-batch", type=float, required=True, help="documents per batch")
    parser.add_argument("--partitions", type=int, default=100)
    parser.add_argument("--learning-rate", type=float, default=0.7)
    parser.add_argument("--decay", type=float, default=1024.0)
    parser.add_argument("--eta", type=float, required=True)
    parser.add_argument("--check-point-freq", type=int, default=5000)
    parser.add_argument("--perplexity-freq", type=int, default=200)
    parser.add_argument("--iterations", type=int, default=100000)
    parser.add_argument("--continue", dest="resume", type=flag, default=False)
    parser.add_argument("--init-lambda", type=flag, default=True)
    parser.add_argument(
        "--alpha", type=float, nargs="+", default=[-1.0], help="one value, or one per topic"
    )
    parser.add_argument("--tf-ranking-min", type=int, default=0)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--lambda-start", choices=("ones", "gamma"), default="ones")
    parser.add_argument("--threshold", type=float, default=0.001, help="stop rule of inference")
    parser.add_argument("--max-inner-iter", type=int, help="steps of inference at most")
    parser.add_argument("--update-alpha", type=flag, default=False, help="train the prior as well")
    add_sizes(parser)
    return parser.parse_args(argv)


def parameters(args: argparse.Namespace) -> TopicParams:
    return TopicParams(
        eta=args.eta,
        mini_batch_fraction=args.mini_batch / args.total_docs,
        vocab_size=args.vocab_size,
        alpha=tuple(args.alpha),
        decay=args.decay,
        learning_rate=args.learning_rate,
        max_outer_iter=args.iterations,
        num_topics=args.topics,
        total_docs=args.total_docs,
        partitions=args.partitions,
        check_point_freq=args.check_point_freq,
        perplexity_freq=args.perplexity_freq,
        init_lambda=args.init_lambda,
        tf_ranking_min=args.tf_ranking_min,
        seed=args.seed,
        lambda_start=args.lambda_start,
        convergence_threshold=args.threshold,
        max_inner_iter=args.max_inner_iter,
        optimize_doc_concentration=args.update_alpha,
        **sizes(args, "broadcast_bytes", "block_bytes"),
    )


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    params = parameters(args)
    spark = SparkSession.builder.appName("topic-training").getOrCreate()
    ship_package(spark)
    corpus = load_corpus(spark, args.corpus, args.format, args.partitions, args.quarantine)
    if args.format == "cells":
        # Every iteration scans the corpus: decode it once.
        corpus = materialise(corpus, "corpus")
    heldout = read_corpus(spark, args.heldout) if args.heldout else None
    if args.heldout_docs:
        path = f"{args.model}/heldout"
        corpus, heldout = split_heldout(corpus, path, args.heldout_docs, args.seed)
        corpus = materialise(corpus, "training")
    if args.resume:
        resume_training(corpus, params, args.model, heldout)
    else:
        train(corpus, params, args.model, heldout, new_model(spark, params, args.lambda_table))


if __name__ == "__main__":
    main()
