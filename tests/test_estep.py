from __future__ import annotations

import numpy as np
import pytest
from plain import infer
from pyspark.sql import functions as F

from themata import schemas
from themata.functions.draws import gamma_draws
from themata.functions.vectors import sum_by_key
from themata.model import TopicModel
from themata.operators import distributions, sampling
from themata.operators.distributions import word_distributions, word_visits
from themata.operators.estep import e_step
from themata.operators.kernel import InferenceSpec
from themata.operators.topicword import start_lambda, word_range
from themata.operators.wordsearch import lane_size, lanes_of_documents
from themata.params import TopicParams
from themata.plans.score import score_topics, score_words
from themata.plans.train import model_of

TOPICS, WORDS = 5, 300
LAYOUTS = {
    "broadcast": {"broadcast_bytes": 1 << 20, "block_bytes": 1 << 20},
    "blocks": {"broadcast_bytes": 1, "block_bytes": 1 << 14},
    # Documents above 20 words do not fit a block.
    "wide": {"broadcast_bytes": 1, "block_bytes": 20 * 8 * TOPICS},
    # The same, with the state of the wide documents broadcast.
    "wide broadcast": {"broadcast_bytes": 2000, "block_bytes": 20 * 8 * TOPICS},
}


@pytest.fixture(scope="module")
def model(spark):
    params = TopicParams(
        eta=0.1, mini_batch_fraction=0.5, num_topics=TOPICS, vocab_size=WORDS, total_docs=100
    )
    lam = start_lambda(word_range(spark, 0, WORDS, 3), TOPICS, "gamma", 5)
    # Peaked rows, so that the documents differ.
    peaked = lam.select(
        "word_id",
        F.transform(
            "lambda",
            lambda v, k: F.when(F.col("word_id") % TOPICS == k, v * 30).otherwise(v),
        ).alias("lambda"),
    )
    return model_of(peaked, params)


def documents():
    """Documents of 1 to 80 words; word 0 is in all of them, some words are unknown."""
    rng = np.random.default_rng(4)
    out = []
    for doc in range(60):
        n = int(rng.integers(1, 80))
        ids = np.unique(np.r_[0, rng.choice(WORDS + 20, n, replace=False)])
        out.append((doc, [int(i) for i in ids], [float(c) for c in rng.integers(1, 6, len(ids))]))
    # One document with every word, and a group of copies as large as all others.
    out.append((2000, list(range(WORDS)), [3.0] * WORDS))
    out += [(3000 + i, [0, 7, 11], [40.0, 1.0, 2.0]) for i in range(30)]
    out.append((1000, [WORDS + 1, WORDS + 5], [1.0, 2.0]))
    out.append((1001, [], []))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(documents(), schemas.CORPUS).repartition(4)


def spec_of(model, **changes):
    values = {"threshold": 0.001, "max_steps": 100, "seed": 9, "iteration": 2}
    return InferenceSpec(model.alpha, model.lambda_sum, **(values | changes))


@pytest.fixture(scope="module")
def expected(model):
    """One document at a time, from the same random start."""
    lam = {r["word_id"]: r["lambda"] for r in model.lam.collect()}
    docs, stats = {}, {}
    for doc, ids, counts in documents():
        known = [(i, c) for i, c in zip(ids, counts) if i in lam]
        if known:
            ids, counts = zip(*known)
            start = gamma_draws(np.array([doc]), TOPICS, 9, 2)[0]
            gamma, s, bounds = infer(ids, counts, lam, model.lambda_sum, model.alpha, start)
            docs[doc] = (gamma, bounds, sum(counts))
            for w, row in zip(ids, s):
                stats[w] = stats.get(w, 0) + row
    return docs, stats


@pytest.mark.parametrize("layout", LAYOUTS)
def test_documents(model, corpus, expected, layout):
    rows = e_step(corpus, model, spec_of(model), "docs", **LAYOUTS[layout]).collect()
    docs, _ = expected
    assert len(rows) == len(docs) == len({r["doc_id"] for r in rows})
    for row in rows:
        gamma, bounds, tokens = docs[row["doc_id"]]
        assert row["gamma"] == pytest.approx(gamma, rel=1e-9)
        assert row["steps"] == len(bounds)
        assert row["bound"] == pytest.approx(bounds[-1], rel=1e-9)
        assert row["tokens"] == tokens
        # All weight goes to the prior or to a counted word.
        assert sum(row["gamma"]) == pytest.approx(model.alpha.sum() + tokens)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_statistics(model, corpus, expected, layout):
    result = e_step(corpus, model, spec_of(model), "stats", **LAYOUTS[layout])
    rows = {r["word_id"]: r["s"] for r in sum_by_key(result, "word_id", "s").collect()}
    _, stats = expected
    assert set(rows) == set(stats)
    for word, row in rows.items():
        assert row == pytest.approx(stats[word], rel=1e-8, abs=1e-12)
    counts = {}
    for _, ids, cts in documents():
        for i, c in zip(ids, cts):
            counts[i] = counts.get(i, 0) + c
    for word, row in rows.items():
        assert sum(row) == pytest.approx(counts[word])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_both(model, corpus, expected, layout):
    rows = e_step(corpus, model, spec_of(model), "both", **LAYOUTS[layout])
    docs, stats = expected
    assert rows.where("doc_id IS NOT NULL").count() == len(docs)
    assert rows.where("word_id IS NOT NULL").select("word_id").distinct().count() == len(stats)


def test_partitions_do_not_matter(model, corpus):
    one = e_step(corpus.coalesce(1), model, spec_of(model), "docs").orderBy("doc_id")
    many = e_step(corpus.repartition(9, "doc_id"), model, spec_of(model), "docs").orderBy("doc_id")
    for a, b in zip(one.collect(), many.collect()):
        assert a["gamma"] == pytest.approx(b["gamma"], rel=1e-12)


def test_bounds_rise(expected):
    docs, _ = expected
    for _, bounds, _ in docs.values():
        assert (np.diff(bounds) > -1e-9).all()


def test_repeated_words_count_as_one(spark, model):
    rows = [(1, [3, 4, 3], [1.0, 2.0, 4.0]), (2, [3, 4], [5.0, 2.0])]
    frame = spark.createDataFrame(rows, schemas.CORPUS)
    start = {"gamma_start": "ones"}
    a, b = e_step(frame, model, spec_of(model, **start), "docs").orderBy("doc_id").collect()
    assert a["gamma"] == pytest.approx(b["gamma"], rel=1e-12)
    one = e_step(frame.where("doc_id = 1"), model, spec_of(model, **start), "stats")
    two = e_step(frame.where("doc_id = 2"), model, spec_of(model, **start), "stats")
    left = {r["word_id"]: r["s"] for r in one.collect()}
    right = {r["word_id"]: r["s"] for r in two.collect()}
    assert left[3] == pytest.approx(right[3]) and left[4] == pytest.approx(right[4])


def test_small_lambda_stays_finite(spark, model):
    params = TopicParams(
        eta=0.1, mini_batch_fraction=0.5, num_topics=2, vocab_size=3, total_docs=1
    )
    lam = spark.createDataFrame(
        [(0, [0.001, 0.001]), (1, [0.001, 5.0]), (2, [3.0, 0.001])], schemas.LAMBDA
    )
    small = model_of(lam, params)
    corpus = spark.createDataFrame([(1, [0, 1, 2], [1.0, 1.0, 1.0])], schemas.CORPUS)
    row = e_step(corpus, small, spec_of(small), "docs").first()
    assert np.isfinite(row["gamma"]).all() and np.isfinite(row["bound"])


def test_bad_counts_stop_the_job(spark, model):
    frame = spark.createDataFrame([(1, [3], [float("nan")])], schemas.CORPUS)
    with pytest.raises(Exception, match="gamma is not finite"):
        e_step(frame, model, spec_of(model), "docs").collect()


def test_scores(spark, model, corpus, expected):
    docs, _ = expected
    rows = {r["doc_id"]: r for r in score_topics(corpus, model, seed=9).collect()}
    assert set(rows) == set(docs)
    for row in rows.values():
        assert sum(row["prob"]) == pytest.approx(1.0)
        assert row["topic_idx"] == sorted(row["topic_idx"])
    every = score_topics(corpus, model, seed=9, emit_prior=True)
    assert every.count() == corpus.count()
    prior = every.where("doc_id = 1000").first()
    assert prior["prob"] == pytest.approx([1 / TOPICS] * TOPICS)


def test_word_scores(spark, model, corpus):
    topics = score_topics(corpus, model, seed=9).select("doc_id", "topic_idx", "prob")
    table = topics.collect()
    lam = {r["word_id"]: np.array(r["lambda"]) for r in model.lam.collect()}
    words = sorted(lam)
    beta = np.array([lam[w] for w in words]) / model.lambda_sum
    want = {}
    for row in table:
        p = beta[:, row["topic_idx"]] @ np.array(row["prob"])
        kept = p >= 1 / WORDS
        want[row["doc_id"]] = (np.array(words)[kept].tolist(), p[kept] / p[kept].sum())
    fixed = spark.createDataFrame(table, schemas.DOC_TOPIC)
    for sizes in ({}, {"broadcast_bytes": 1, "chunk_bytes": 900}, {"broadcast_bytes": 1}):
        found = score_words(fixed, model, **sizes).collect()
        assert len(found) == len(want)
        for row in found:
            ids, probs = want[row["doc_id"]]
            assert row["word_ids"] == ids
            assert row["probs"] == pytest.approx(probs, rel=1e-10)
            assert row["cell"].count(",") == 2 * (len(ids) - 1)


def test_chunks_keep_documents_without_words(spark):
    """Shares that do not sum to one, and a table none of whose words reaches 1/V."""
    lam = spark.createDataFrame(
        [(w, [1.0 + w % 3, 2.0]) for w in range(40)], "word_id BIGINT, lambda ARRAY<DOUBLE>"
    )
    model = TopicModel(
        lam=lam,
        alpha=np.array([0.5, 0.5]),
        eta=0.1,
        num_updates=0,
        num_topics=2,
        total_docs=3,
        num_words=40,
        lambda_sum=np.array([79.0, 80.0]),
    )
    for shares in ([0.3, 0.2], [0.5, 0.5], [1e-6, 1e-6]):
        docs = spark.createDataFrame(
            [(d, [0, 1], shares) for d in range(3)],
            "doc_id BIGINT, topic_idx ARRAY<INT>, prob ARRAY<DOUBLE>",
        )
        whole = word_distributions(docs, model).orderBy("doc_id").collect()
        for chunk_bytes in (1 << 20, 160):
            parts = word_distributions(docs, model, broadcast_bytes=1, chunk_bytes=chunk_bytes)
            assert [r["doc_id"] for r in parts.orderBy("doc_id").collect()] == [0, 1, 2]
            for a, b in zip(whole, parts.orderBy("doc_id").collect()):
                assert list(a["word_ids"]) == list(b["word_ids"])
                assert a["probs"] == pytest.approx(b["probs"])


def random_documents(draw, topics, n):
    """Sparse documents, half of them of one topic, some of all."""
    rows = []
    for d in range(n):
        size = 1 if d % 2 else draw.integers(1, topics + 1)
        chosen = np.sort(draw.choice(topics, size, replace=False) if d % 2 == 0 else [d % 3 // 2])
        share = draw.dirichlet(np.full(size, 0.5))
        rows.append((d, chosen.tolist(), share.tolist()))
    return rows


@pytest.mark.parametrize("topics_held", [0, 2, 7, 12])
def test_threshold_search_finds_all_words(spark, topics_held):
    draw = np.random.default_rng(8)
    topics, words = 12, 700
    lam = draw.gamma(0.05, 1.0, (words, topics)) + 1e-3
    table = spark.createDataFrame(
        [(int(w), row.tolist()) for w, row in enumerate(lam)], schemas.LAMBDA
    )
    params = TopicParams(
        eta=0.1, mini_batch_fraction=0.5, num_topics=topics, vocab_size=words, total_docs=1
    )
    model = model_of(table, params)
    rows = random_documents(draw, topics, 300) + [(300, [], []), (301, [4], [0.0])]
    docs = spark.createDataFrame(rows, schemas.DOC_TOPIC).repartition(3)
    beta = lam / lam.sum(axis=0)
    found = {r["doc_id"]: r for r in word_distributions(docs, model, 1, 8 * words * topics_held).collect()}
    assert sorted(found) == list(range(302))
    for d, k, theta in rows:
        p = beta[:, k] @ np.array(theta) if k else np.zeros(words)
        want = np.flatnonzero((p >= 1 / words) & (p > 0))
        assert found[d]["word_ids"] == want.tolist()
        assert found[d]["probs"] == pytest.approx(p[want] / max(p[want].sum(), 1e-300))
    if topics_held == 12:
        visits = {r["doc_id"]: r for r in word_visits(docs, model, 8 * words * topics_held).collect()}
        for d, k, theta in rows:
            assert visits[d]["kept"] == len(found[d]["word_ids"]) <= visits[d]["visited"]
            if len(k) == 1:
                assert visits[d]["visited"] == visits[d]["kept"]
        # Far fewer pairs than documents times words.
        assert sum(r["visited"] for r in visits.values()) < 0.5 * len(rows) * words


def test_lanes_hold_a_bounded_number_of_topics(spark):
    draw = np.random.default_rng(9)
    rows = random_documents(draw, 12, 400)
    docs = spark.createDataFrame(rows, schemas.DOC_TOPIC)
    laned = lanes_of_documents(docs, 4, 5, 30).collect()
    by_lane = {}
    for r in laned:
        by_lane.setdefault(r["lane"], []).append(r["topic_idx"])
    assert len(laned) == 400
    assert all(len(k) > 5 for k in by_lane.pop(-1))
    for topics in by_lane.values():
        assert len(topics) <= 30 and len(set().union(*topics)) <= 5
    # The topic that a third of the documents have is in many lanes.
    assert sum([1] in topics for topics in by_lane.values()) >= 2
    assert lane_size(10, 5) == lane_size(10**6, 1) < lane_size(10**9, 3000)


def test_tasks_grow_with_documents():
    assert distributions.lanes_of(10, 4, 200) == 50
    assert distributions.lanes_of(10**9, 400, 200) > 10_000
    assert sampling.lanes_of(5, 8) == 1
    assert sampling.lanes_of(1000, 8) == 8
    assert sampling.lanes_of(10**9, 8) > 10_000


def test_settled_documents_leave_their_tile(monkeypatch):
    """Documents that settle early are not multiplied again until half of a tile has settled."""
    from themata.operators import kernel as K

    rng = np.random.default_rng(3)
    beta = rng.dirichlet(np.ones(60), 3).T
    words = K.WordRows(np.arange(60), np.log(beta))
    # A third of the documents have one word and settle at once, the others take many steps.
    sizes = np.array([1] * 8 + [40] * 16)
    ids = np.concatenate([rng.choice(60, n, replace=False) for n in sizes])
    offsets = np.r_[0, np.cumsum(sizes)]
    docs = K.Documents.of(np.arange(24), offsets, ids, rng.integers(1, 5, len(ids)).astype(float), words)
    spec = K.InferenceSpec(np.full(3, 0.3), np.ones(3), 1e-9, None, 1, 0, "ones")
    rows, plain = [], np.matmul
    monkeypatch.setattr(K.np, "matmul", lambda a, b: (rows.append(len(a)), plain(a, b))[1])
    gamma = np.ones((24, 3))
    res = K.TileResult(gamma, np.exp(K.dirichlet_expectation(gamma)), np.zeros(24, np.int32))
    left = K._advance(K.Tile.of(docs, np.arange(24)), res, np.arange(24), words, spec)
    assert 2 * left.sum() <= 24
    assert sum(rows) < 2 * 24 * res.steps.max()
    for d in range(24):
        one = K.TileResult(gamma[:1] * 0 + 1, np.exp(K.dirichlet_expectation(np.ones((1, 3)))), np.zeros(1, np.int32))
        K._advance(K.Tile.of(docs, np.array([d])), one, np.zeros(1, np.int64), words, spec)
        if not left[d]:
            assert res.steps[d] == one.steps[0]
            assert res.gamma[d] == pytest.approx(one.gamma[0], rel=1e-9)


def test_few_blocks_for_a_small_corpus(spark, model, corpus, monkeypatch):
    """A small corpus has few blocks at any number of partitions."""
    from themata.operators import estep as E

    seen, plain = [], E._block_e_step
    monkeypatch.setattr(E, "_block_e_step", lambda *a: (seen.append(a[2]), plain(*a))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        # Room for the first 50 words; all documents fit a block.
        found = e_step(corpus, model, spec_of(model), "docs", broadcast_bytes=50 * 8 * TOPICS)
        rows = {r["doc_id"]: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] <= E.BLOCKS_PER_TASK * spark.sparkContext.defaultParallelism
    same = {r["doc_id"]: r for r in e_step(corpus, model, spec_of(model), "docs").collect()}
    assert rows.keys() == same.keys()
    for doc, r in rows.items():
        assert r["gamma"] == pytest.approx(same[doc]["gamma"], rel=1e-9)
        assert r["bound"] == pytest.approx(same[doc]["bound"], rel=1e-9)
