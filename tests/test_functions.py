from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themata.functions.draws import gamma_draws, poisson_thresholds
from themata.functions.special import (
    digamma,
    digamma_col,
    dirichlet_expectation,
    dirichlet_expectation_col,
    lgamma,
    lgamma_col,
    trigamma,
)
from themata.functions.vectors import (
    column_fold,
    euclidean_distance,
    log_sum_exp,
    normalise,
    sum_by_key,
    vector_add,
    vector_multiply,
)

EULER = 0.5772156649015329


def test_known_values():
    assert digamma(np.array([1.0, 0.5])) == pytest.approx(
        [-EULER, -EULER - 2 * math.log(2)], abs=1e-13
    )
    assert trigamma(np.array([1.0, 0.5])) == pytest.approx(
        [math.pi**2 / 6, math.pi**2 / 2], abs=1e-12
    )
    assert digamma(np.array([0.001]))[0] == pytest.approx(-1000.5755719, abs=1e-7)
    assert np.exp(digamma(np.array([0.001])))[0] == 0.0


@given(st.floats(min_value=1e-4, max_value=1e7))
@settings(max_examples=200, deadline=None)
def test_recurrences(x):
    v = np.array([x])
    assert lgamma(v)[0] == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
    assert digamma(v + 1)[0] - digamma(v)[0] == pytest.approx(1 / x, rel=1e-8, abs=1e-9)
    assert trigamma(v)[0] - trigamma(v + 1)[0] == pytest.approx(1 / x**2, rel=1e-8, abs=1e-9)


def test_columns_agree_with_numpy(spark):
    x = np.array([0.001, 0.25, 1.0, 3.5, 120.0, 1e5])
    frame = spark.createDataFrame([(x.tolist(),)], "x ARRAY<DOUBLE>")
    row = frame.select(
        F.transform("x", digamma_col).alias("d"),
        F.transform("x", lgamma_col).alias("l"),
        dirichlet_expectation_col(F.col("x")).alias("own"),
        dirichlet_expectation_col(F.col("x"), F.transform("x", lambda v: v + 1)).alias("given"),
        normalise(F.col("x")).alias("n"),
        log_sum_exp(F.col("x")).alias("lse"),
    ).first()
    assert row["d"] == pytest.approx(digamma(x), rel=1e-13)
    assert row["l"] == pytest.approx(lgamma(x), rel=1e-12, abs=1e-12)
    assert row["own"] == pytest.approx(dirichlet_expectation(x), rel=1e-12)
    assert row["given"] == pytest.approx(digamma(x) - digamma(x + 1), abs=1e-11)
    assert row["n"] == pytest.approx(x / x.sum())
    assert row["lse"] == pytest.approx(1e5)


def test_element_wise(spark):
    rows = [(1, [1.0, 2.0, 3.0], [4.0, 5.0]), (2, [1.0, 2.0], None)]
    frame = spark.createDataFrame(rows, "id INT, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>")
    a, b = (
        frame.select(
            vector_add(F.col("x"), F.col("y")).alias("s"),
            vector_multiply(F.col("x"), F.col("y")).alias("p"),
            euclidean_distance(F.col("x"), F.col("y")).alias("d"),
        )
        .collect()
    )
    assert a["s"] == [5.0, 7.0] and a["p"] == [4.0, 10.0]
    assert a["d"] == pytest.approx(math.sqrt(18.0))
    assert b["p"] == [1.0, 2.0] and b["s"] is None


def test_sum_by_key_with_a_hot_key(spark):
    """A third of the rows share one key; the batches are much smaller than the group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        frame = spark.range(30000).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("bigint").alias("k"),
            F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"),
        )
        found = {r["k"]: r["v"] for r in sum_by_key(frame, "k", "v").collect()}
        want = frame.groupBy("k").agg(
            F.sum(F.col("v")[0]).alias("n"), F.sum(F.col("v")[1]).alias("s")
        )
        assert found == {r["k"]: [r["n"], r["s"]] for r in want.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_column_fold(spark):
    frame = spark.createDataFrame([([1.0, -2.0],), ([0.5, 4.0],)], "v ARRAY<DOUBLE>")
    sums = {r["topic"]: r["value"] for r in column_fold(frame, "v", "sum").collect()}
    peaks = {r["topic"]: r["value"] for r in column_fold(frame, "v", "max").collect()}
    assert sums == {0: 1.5, 1: 2.0} and peaks == {0: 1.0, 1: 4.0}
    assert column_fold(frame.where(F.lit(False)), "v", "sum").count() == 0


def test_gamma_draws():
    ids = np.arange(2000)
    values = gamma_draws(ids, 10, seed=1, iteration=3)
    assert (values > 0).all()
    assert values.mean() == pytest.approx(1.0, abs=0.003)
    assert values.std() == pytest.approx(0.1, abs=0.003)
    # A row depends on its id alone, not on its neighbours.
    assert (gamma_draws(ids[::-7], 10, 1, 3) == values[::-7]).all()
    assert (gamma_draws(ids, 10, 1, 4) != values).all()
    assert (gamma_draws(ids, 10, 2, 3) != values).all()


@pytest.mark.parametrize("rate", [0.01, 0.5, 3.0])
def test_poisson_thresholds(rate):
    steps = np.array(poisson_thresholds(rate))
    assert (np.diff(steps) >= 0).all() and steps[-1] <= 1
    u = (np.arange(200000) + 0.5) / 200000
    draws = (u[:, None] >= steps).sum(axis=1)
    assert draws.mean() == pytest.approx(rate, abs=1e-3)
    assert draws.var() == pytest.approx(rate, abs=1e-2)
