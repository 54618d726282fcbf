from __future__ import annotations

import pytest
from odd_rows import INTERNAL, ODD
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    frame = spark.createDataFrame(
        [(*r, "x", 1, "y") for r in ODD],
        "doc_id long, text string, lang string, source string, shingles string, n_words int, kept string",
    )
    return frame.withColumns({n: F.lit(n) for n in INTERNAL})
