"""The worked example with two topics, three words and one document."""

from __future__ import annotations

import numpy as np
import pytest
from plain import infer
from pyspark.sql import functions as F

from themata import schemas
from themata.functions.vectors import sum_by_key
from themata.model import TopicModel
from themata.operators.alpha import mean_log_theta, newton_step, update_alpha
from themata.operators.bound import log_perplexity, topic_bound
from themata.operators.distributions import sparse_topics, topic_cells, word_distributions
from themata.operators.estep import e_step
from themata.operators.kernel import InferenceSpec
from themata.operators.mstep import m_step
from themata.operators.topictable import store_rows
from themata.storage import new_folder
from themata.operators.topicword import lambda_sums, peak_median
from themata.params import TopicParams

LAM = [[2.0, 1.0], [1.0, 3.0], [1.0, 1.0]]


@pytest.fixture(scope="module")
def model(spark):
    lam = spark.createDataFrame([(i, row) for i, row in enumerate(LAM)], schemas.LAMBDA)
    return TopicModel(lam, np.array([0.5, 0.5]), 0.1, 0, 2, 10, 3, np.array([4.0, 5.0]))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(7, [0, 1], [3.0, 1.0])], schemas.CORPUS)


def spec(model, steps=100, threshold=0.001):
    return InferenceSpec(
        model.alpha, model.lambda_sum, threshold, steps, gamma_start="ones"
    )


@pytest.mark.parametrize(
    "steps, gamma, bound",
    [
        (1, [3.0545997223, 1.9454002777], -5.5744888999),
        (2, [3.4104600037, 1.5895399963], -5.4604503700),
        (3, None, -5.4107763173),
        (100, [4.0314903838, 0.9685096162], -5.3695615309),
    ],
)
def test_document_step(model, corpus, steps, gamma, bound):
    row = e_step(corpus, model, spec(model, steps), "docs").first()
    if gamma:
        assert row["gamma"] == pytest.approx(gamma, abs=1e-9)
    assert row["bound"] == pytest.approx(bound, abs=1e-9)
    assert row["tokens"] == 4.0
    if steps == 100:
        assert row["steps"] == 17


def test_statistics_and_update(model, corpus):
    stats = e_step(corpus, model, spec(model), "stats")
    found = {r["word_id"]: r["s"] for r in sum_by_key(stats, "word_id", "s").collect()}
    assert found[0] == pytest.approx([2.8761644, 0.1238356], abs=1e-7)
    assert found[1] == pytest.approx([0.65594108, 0.34405892], abs=1e-7)
    params = TopicParams(eta=0.1, mini_batch_fraction=0.1, num_topics=2)
    rho = params.step_size(1)
    assert rho == pytest.approx(0.0078071639, abs=1e-10)
    rewritten = m_step(model.lam, sum_by_key(stats, "word_id", "s"), rho, 0.1, 10.0)
    path = new_folder(model.lam.sparkSession, "golden")
    table, touched = store_rows(model.lam, 2, 2, f"{path}/a").add(stats, rho, 0.1, 10.0, path)
    expected = [[2.20971326, 1.0026416], [1.04418395, 3.00422047], [0.99297355, 0.99297355]]
    for updated in (rewritten, table.lam()):
        for row, want in zip(updated.orderBy("word_id").collect(), expected):
            assert row["lambda"] == pytest.approx(want, abs=1e-8)
    assert touched == 2
    assert table.lambda_sums() == pytest.approx([4.24687076, 4.99983562], abs=1e-8)


def test_updated_sums(model, corpus):
    stats = e_step(corpus, model, spec(model), "stats")
    stats = sum_by_key(stats, "word_id", "s")
    updated = m_step(model.lam, stats, 1025.0**-0.7, 0.1, 10.0)
    assert lambda_sums(updated) == pytest.approx([4.24687076, 4.99983562], abs=1e-8)


def test_topic_bound_and_perplexity(model, corpus):
    parts = topic_bound(model)
    assert parts.part1 == pytest.approx(10.325, abs=1e-9)
    assert parts.part2 == pytest.approx(-12.8231287298, abs=1e-9)
    assert parts.part3 == pytest.approx(-2.7782173099, abs=1e-9)
    result = log_perplexity(corpus, model, spec(model))
    assert result.value == pytest.approx(2.6614768927, abs=1e-9)
    assert result.tokens == result.raw_tokens == 4.0


def test_bound_never_falls(model):
    _, _, bounds = infer(
        [0, 1], [3, 1], dict(enumerate(LAM)), model.lambda_sum, model.alpha, [1.0, 1.0]
    )
    assert (np.diff(bounds) > -1e-12).all() and len(bounds) == 17


def test_peak_median(model):
    assert peak_median(model.lam).first()[0] == 2.5


def test_sparse_topics(spark):
    rows = [(1, [5.0, 3.0, 1.5, 0.5]), (2, [1.0, 1.0, 1.0, 1.0])]
    gammas = spark.createDataFrame(rows, "doc_id BIGINT, gamma ARRAY<DOUBLE>")
    found = {r["doc_id"]: r for r in topic_cells(sparse_topics(gammas, 4)).collect()}
    assert found[1]["topic_idx"] == [0, 1]
    assert found[1]["prob"] == pytest.approx([0.625, 0.375])
    ids, probs = found[1]["cell"].split(":")
    assert ids == "0,1" and [float(p) for p in probs.split(",")] == found[1]["prob"]
    assert found[2]["topic_idx"] == [0, 1, 2, 3]


def test_equal_shares_keep_a_topic(spark):
    """Shares that all round below 1/T still leave one topic."""
    gammas = spark.createDataFrame([(1, [0.1] * 49)], "doc_id BIGINT, gamma ARRAY<DOUBLE>")
    row = sparse_topics(gammas, 49).first()
    assert len(row["topic_idx"]) >= 1 and sum(row["prob"]) == pytest.approx(1.0)


def test_word_distribution(spark, model):
    topics = spark.createDataFrame([(1, [0, 1], [0.75, 0.25])], schemas.DOC_TOPIC)
    row = word_distributions(topics, model).first()
    assert row["word_ids"] == [0, 1]
    assert row["probs"] == pytest.approx([0.55737705, 0.44262295], abs=1e-8)
    chunked = word_distributions(topics, model, broadcast_bytes=1, chunk_bytes=16).first()
    assert chunked == row


def test_alpha(spark):
    gammas = spark.createDataFrame([([4.0, 1.0],), ([1.5, 2.5],)], "gamma ARRAY<DOUBLE>")
    alpha = np.array([0.5, 0.5])
    mean, docs = mean_log_theta(gammas)
    assert docs == 2
    # Row sums, not the column sums [-0.96, -1.04].
    assert mean == pytest.approx([-0.7348138472, -1.3181471806], abs=1e-9)
    assert newton_step(alpha, mean, 2) == pytest.approx([0.2778446131, 0.1596365656], abs=1e-9)
    assert update_alpha(alpha, gammas, 0.5) == pytest.approx(
        [0.6389223066, 0.5798182828], abs=1e-9
    )
    # A step that would leave a value at or below 0 is not taken.
    assert (update_alpha(alpha, gammas, -10.0) == alpha).all()
    empty = gammas.where(F.lit(False))
    assert (update_alpha(alpha, empty, 0.5) == alpha).all()
