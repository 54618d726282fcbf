"""Score documents: sparse topic distributions.

    spark-submit --py-files themata.zip apps/doc_topics.py --corpus ... --model ... --out ...
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from common import add_corpus, add_sizes, flag, load_corpus, sizes  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from themata.plans.score import score_topics  # noqa: E402
from themata.session import ship_package  # noqa: E402
from themata.sources.models import load_model  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    add_corpus(parser)
    parser.add_argument("--model", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--threshold", type=float, default=0.001)
    parser.add_argument("--max-inner-iter", type=int)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--emit-prior", type=flag, default=False)
    add_sizes(parser)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("document-topics").getOrCreate()
    ship_package(spark)
    corpus = load_corpus(spark, args.corpus, args.format, None, args.quarantine)
    model = load_model(spark, args.model)
    scored = score_topics(
        corpus,
        model,
        args.threshold,
        args.max_inner_iter,
        args.seed,
        emit_prior=args.emit_prior,
        **sizes(args, "broadcast_bytes", "block_bytes"),
    )
    scored.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
