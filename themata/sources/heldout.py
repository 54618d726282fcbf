"""Documents that are held out from training, drawn once and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from themata.operators.sampling import heldout_draw, training_part
from themata.sources.corpus import read_corpus
from themata.storage import path_exists


def split_heldout(corpus: DataFrame, path: str, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The training documents and ``n`` held-out ones, which are stored at ``path``.

    A split that is stored already is used as it is, so a resumed or repeated job trains on the same
    documents; ``n`` and ``seed`` then have no effect.
    """
    spark = corpus.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        drawn = heldout_draw(corpus.select("doc_id", "word_ids", "word_cts"), n, seed)
        drawn.write.mode("overwrite").parquet(path)
    heldout = read_corpus(spark, path)
    return training_part(corpus, heldout), heldout
