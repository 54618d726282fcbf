"""The M-step as one expression: decay every topic-word row and add the statistics of its word.

Training adds deltas instead (``topictable.py``); this is the form that rewrites all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def m_step(lam: DataFrame, stats: DataFrame, rho: float, eta: float, ratio: float) -> DataFrame:
    """``(word_id, lambda)`` after one step, from one row of summed statistics per touched word.

    ``ratio`` is D / |mb|. Words without a row in ``lam`` are dropped.
    """
    decay, floor, gain = F.lit(1.0 - rho), F.lit(rho * eta), F.lit(rho * ratio)
    untouched = F.transform("lambda", lambda v: decay * v + floor)
    touched = F.zip_with("lambda", "s", lambda v, s: decay * v + floor + gain * s)
    joined = lam.select("word_id", "lambda").join(
        stats.select("word_id", "s").hint("merge"), "word_id", "left"
    )
    new = F.when(F.col("s").isNull(), untouched).otherwise(touched)
    return joined.select("word_id", new.alias("lambda"))
