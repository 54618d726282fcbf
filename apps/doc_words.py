"""Score documents: sparse word distributions from their topic distributions.

    spark-submit --py-files themata.zip apps/doc_words.py --topics ... --model ... --out ...
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from common import sizes  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from themata.plans.score import score_words  # noqa: E402
from themata.session import ship_package  # noqa: E402
from themata.sources.corpus import topic_distributions  # noqa: E402
from themata.sources.models import load_model  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--topics", required=True, help="output of doc_topics.py")
    parser.add_argument(
        "--from-cells", action="store_true", help="read the encoded cells, not the arrays"
    )
    parser.add_argument("--model", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--broadcast-bytes", type=int, help="largest table that is broadcast")
    parser.add_argument("--chunk-bytes", type=int, help="rows of a larger table in one task")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("document-words").getOrCreate()
    ship_package(spark)
    scored = spark.read.parquet(args.topics)
    topics = topic_distributions(scored.select("doc_id", "cell")) if args.from_cells else scored
    model = load_model(spark, args.model)
    limits = sizes(args, "broadcast_bytes", "chunk_bytes")
    scored = score_words(topics.select("doc_id", "topic_idx", "prob"), model, **limits)
    scored.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
