from __future__ import annotations

import sys
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from themata import schemas
from themata.functions.vectors import sum_by_key
from themata.operators.estep import e_step
from themata.operators.mstep import m_step
from themata.operators.sampling import BatchWindow, DirectBatches, draw_minibatch, lanes_of
from themata.operators.topictable import compensated, store_rows, sum_statistics
from themata.operators.topicword import lambda_sums, start_lambda, word_range
from themata.params import TopicParams
from themata.plans.train import (
    evaluate,
    inference_spec,
    model_of,
    new_model,
    next_window,
    resume_training,
    train,
    trainable,
    update,
)
from themata.sources import corpus as C
from themata.sources.heldout import split_heldout
from themata.sources.metrics import read_metrics
from themata.sources.models import load_model, save_lambda, save_model, saved_versions
from themata.storage import materialise, new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(8)
    bags = materialise(C.bags_of_words(raw), "bags")
    vocab = materialise(C.vocabulary(bags, min_df=5), "vocabulary")
    return materialise(
        C.collect_documents(C.encode_words(C.word_counts(bags), vocab)), "corpus"
    )


@pytest.fixture(scope="module")
def params(corpus):
    size = corpus.agg(F.max(F.array_max("word_ids")) + 1).first()[0]
    return TopicParams(
        eta=0.1,
        mini_batch_fraction=0.3,
        vocab_size=size,
        num_topics=5,
        total_docs=corpus.count(),
        decay=8.0,
        max_outer_iter=20,
        perplexity_freq=5,
        check_point_freq=10,
        partitions=4,
        seed=3,
    )


def table(model):
    return {r["word_id"]: r["lambda"] for r in model.lam.collect()}


def same(a, b, rel=1e-9):
    a, b = table(a), table(b)
    assert set(a) == set(b)
    for word in a:
        assert a[word] == pytest.approx(b[word], rel=rel)


def test_perplexity_falls_and_is_logged(spark, corpus, params, tmp_path):
    root = str(tmp_path / "model")
    model = train(corpus, params, root, heldout=corpus.where("doc_id % 4 = 0"))
    rows = read_metrics(spark, f"{root}/metrics").collect()
    values = {(r["metric"], r["iter"]): r["value"] for r in rows}
    perplexity = [values["log_perplexity", i] for i in (5, 10, 15, 20)]
    assert perplexity == sorted(perplexity, reverse=True)
    assert {i for m, i in values if m == "peak_median"} == {10, 20}
    assert all(("seconds", i) in values and ("batch_docs", i) in values for i in range(1, 21))
    versions = saved_versions(spark, root)
    assert [v.split("/")[0] for v in versions] == ["iter=00000010", "iter=00000020"]
    assert model.num_updates == 20
    assert min(min(v) for v in table(model).values()) > 0
    same(model, load_model(spark, root), rel=0)


def test_resumed_training_is_the_same(corpus, params, tmp_path):
    root = str(tmp_path / "model")
    six = replace(params, max_outer_iter=6, perplexity=False)
    whole = train(corpus, six)
    train(corpus, replace(six, max_outer_iter=2), root)
    resumed = resume_training(corpus, six, root)
    assert resumed.num_updates == 6
    same(whole, resumed)
    with pytest.raises(ValueError, match="eta"):
        resume_training(corpus, replace(six, eta=0.2), root)
    with pytest.raises(ValueError, match="topics"):
        resume_training(corpus, replace(six, num_topics=6), root)


def test_layout_does_not_change_training(corpus, params):
    three = replace(params, max_outer_iter=3, perplexity=False)
    blocks = replace(three, broadcast_bytes=1 << 10, block_bytes=1 << 16)
    same(train(corpus, three), train(corpus, blocks), rel=1e-7)


def test_sums_follow_the_update(corpus, params):
    """Sums' = (1 - rho) Sums + rho eta V + rho D / |mb| sum of statistics."""
    model = new_model(corpus.sparkSession, replace(params, lambda_start="gamma"))
    spec = inference_spec(model, params, 1)
    new, words = update(model, corpus, corpus.count(), params, new_folder(corpus.sparkSession, "u"))
    stats = sum_by_key(e_step(corpus, model, spec, "stats"), "word_id", "s")
    total = np.sum([r["s"] for r in stats.collect()], axis=0)
    rho = params.step_size(1)
    want = (1 - rho) * model.lambda_sum + rho * params.eta * model.num_words + rho * total
    assert new.lambda_sum == pytest.approx(want, rel=1e-10)
    assert words == stats.count()


def test_update_drops_words_outside_the_table(spark):
    lam = start_lambda(word_range(spark, 0, 3, 1), 2)
    stats = spark.createDataFrame([(1, [1.0, 2.0]), (9, [5.0, 5.0]), (1, [1.0, 0.0])], schemas.STATS)
    rows = {r["word_id"]: r["lambda"] for r in m_step(lam, sum_by_key(stats, "word_id", "s"), 0.5, 0.1, 2.0).collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[1] == pytest.approx([0.5 + 0.5 * (0.1 + 4.0), 0.5 + 0.5 * (0.1 + 4.0)])
    assert rows[0] == pytest.approx([0.55, 0.55])


def table_after(model, stats_of, params, path, iterations, **held):
    """The table after so many M-steps, and lambda by the plain update of all rows."""
    table = store_rows(model.lam, 4, params.num_topics, f"{path}/start", **held)
    ids, plain = model.rows()
    at = {w: i for i, w in enumerate(ids)}
    for i in range(1, iterations + 1):
        stats, rho = stats_of(i), params.step_size(i)
        table, touched = table.add(stats, rho, params.eta, 2.0, f"{path}/{i}")
        plain = (1 - rho) * plain + rho * params.eta
        words = set()
        for row in stats.collect():
            if row["word_id"] in at:
                plain[at[row["word_id"]]] += rho * 2.0 * np.asarray(row["s"])
                words.add(row["word_id"])
        assert touched == len(words)
    return table, ids, plain


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("decay", [8.0, 0.0])
def test_deltas_add_up_to_the_plain_update(spark, params, tmp_path, limit, decay):
    """Over several merges, repeated words and, without decay, a first step that leaves nothing."""
    few = replace(params, vocab_size=30, num_topics=3, lambda_start="gamma", decay=decay)
    model = new_model(spark, few)

    def stats_of(i):
        rows = [((7 * i + j) % 30, [float(i), j / 3.0, 1.0]) for j in range(1 + i % 9)]
        return spark.createDataFrame(rows + rows[:1], schemas.STATS)

    table, ids, plain = table_after(model, stats_of, few, str(tmp_path), 20, limit=limit)
    found = {r["word_id"]: r["lambda"] for r in table.lam().collect()}
    assert sorted(found) == list(ids)
    for w, row in zip(ids, plain):
        assert found[w] == pytest.approx(row, rel=1e-12)
    assert table.lambda_sums() == pytest.approx(plain.sum(axis=0), rel=1e-12)
    assert (table.held is not None) == (limit > 0)
    if limit:
        assert table.held_lambda()[1] == pytest.approx(plain, rel=1e-12)
    # Merged deltas are gone from storage.
    assert len(table.deltas) < 20 and not Path(tmp_path / "2" / "delta").exists()


def test_sums_do_not_drift(spark, params, tmp_path):
    few = replace(params, vocab_size=50, num_topics=2, lambda_start="gamma")
    model = new_model(spark, few)
    draw = np.random.default_rng(5)

    def stats_of(i):
        words = draw.choice(50, 10, replace=False).tolist()
        values = (10.0 ** draw.uniform(-8, 3, (10, 2))).tolist()
        return spark.createDataFrame(list(zip(words, values)), schemas.STATS)

    table = store_rows(model.lam, 2, 2, str(tmp_path / "start"))
    for i in range(1, 101):
        table, _ = table.add(stats_of(i), few.step_size(i), 0.1, 50.0, str(tmp_path / str(i)))
    assert table.lambda_sums() == pytest.approx(lambda_sums(table.lam()), rel=1e-9)


def test_compensated_sums_keep_small_parts():
    total, carry = np.array([1e16]), np.zeros(1)
    for _ in range(1000):
        total, carry = compensated(total, carry, np.array([1.0]))
    assert total + carry == 1e16 + 1000


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_only_statistics_are_shuffled(spark, params, tmp_path):
    few = replace(params, vocab_size=40, num_topics=3)
    stats = spark.createDataFrame([(w, [1.0, 2.0, 3.0]) for w in range(0, 40, 3)], schemas.STATS)
    table = store_rows(new_model(spark, few).lam, 4, 3, str(tmp_path / "start"))
    for i in (1, 2):
        assert exchanges(sum_statistics(stats, 1.0, 4)) == 1
        table, _ = table.add(stats, 0.5, 0.1, 2.0, str(tmp_path / str(i)))
    assert exchanges(table.lam()) == 0
    rows = table.lam()
    rows.collect()
    plan = rows._jdf.queryExecution().toString()
    assert plan.count("Bucketed: true") >= 3
    # A condition on words reaches the files of rows and deltas.
    some = table.lam().where("word_id < 3")._jdf.queryExecution().executedPlan().toString()
    assert some.count("LessThan(word_id,3)") >= 3


def test_an_iteration_writes_the_touched_rows_only(spark, corpus, params, tmp_path):
    large = replace(params, vocab_size=200_000, broadcast_bytes=1 << 10)
    model = trainable(new_model(spark, large), large, str(tmp_path / "start"))
    few = corpus.limit(5)
    new, words = update(model, few, 5, large, str(tmp_path / "one"))
    delta = spark.read.parquet(str(tmp_path / "one" / "delta"))
    assert delta.count() == words < 5_000
    assert new.lam.count() == 200_000
    size = lambda p: sum(f.stat().st_size for f in Path(p).rglob("*.parquet"))
    assert [p.name for p in (tmp_path / "one").iterdir()] == ["delta"]
    assert size(tmp_path / "one") < words * 8 * params.num_topics + 100_000


def test_large_batches_are_drawn_from_the_corpus(spark, corpus, params):
    small = replace(params, mini_batch_fraction=0.05)
    direct, window = next_window(corpus, params, 1), next_window(corpus, small, 1)
    assert isinstance(direct, DirectBatches) and isinstance(window, BatchWindow)
    for batches, fraction in ((direct, 0.3), (window, 0.05)):
        for i in (1, 3):
            want = draw_minibatch(corpus, fraction, params.seed, i).orderBy("doc_id").collect()
            found = batches.batch(i).orderBy("doc_id").collect()
            assert [(r["doc_id"], r["draws"], r["word_cts"]) for r in found] == [
                (r["doc_id"], r["draws"], r["word_cts"]) for r in want
            ]
            assert batches.docs.get(i, 0) == sum(r["draws"] for r in want)
    wide = BatchWindow(corpus, 0.1, params.seed, 1, 4, 10 * 32 * 8)
    for i in range(1, 5):
        # As many files as lanes, so as many tasks, and no lane in two of them.
        files = list((Path(wide.path) / f"iteration={i}").glob("*.parquet"))
        assert 4 <= len(files) <= lanes_of(32 * 8, 8) == 8
    window.drop()
    wide.drop()
    assert not Path(wide.path).exists()


def test_prior_update(corpus, params):
    on = replace(params, max_outer_iter=3, optimize_doc_concentration=True, perplexity=False)
    model = train(corpus, on)
    assert (model.alpha > 0).all() and not np.allclose(model.alpha, 0.2)


def test_empty_batch_is_skipped(corpus, params):
    tiny = replace(params, mini_batch_fraction=1e-9, max_outer_iter=2, perplexity=False)
    model = train(corpus, tiny)
    assert model.num_updates == 2
    assert set(map(tuple, table(model).values())) == {(1.0,) * 5}


def test_drawn_twice_is_doubled_counts(spark, corpus, params):
    model = new_model(spark, replace(params, lambda_start="gamma"))
    spec = replace(inference_spec(model, params, 1), gamma_start="ones")
    twice = corpus.select(
        "doc_id", "word_ids", F.transform("word_cts", lambda c: c * 2).alias("word_cts")
    )
    repeated = corpus.select(
        "doc_id",
        F.concat("word_ids", "word_ids").alias("word_ids"),
        F.concat("word_cts", "word_cts").alias("word_cts"),
    )
    a = e_step(twice, model, spec, "docs").orderBy("doc_id").collect()
    b = e_step(repeated, model, spec, "docs").orderBy("doc_id").collect()
    for x, y in zip(a, b):
        assert x["gamma"] == pytest.approx(y["gamma"], rel=1e-8)


def test_incomplete_versions_are_ignored(spark, corpus, params, tmp_path):
    root = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        load_model(spark, root)
    model = new_model(spark, params)
    save_model(model, root)
    # A save that stopped before its metadata.
    save_lambda(model.lam, f"{root}/iter=00000009/save-1/lambda")
    assert load_model(spark, root).num_updates == 0


def test_a_finished_model_survives_resuming(spark, corpus, params, tmp_path):
    root = str(tmp_path / "model")
    two = replace(params, max_outer_iter=2, check_point_freq=1, perplexity=False)
    model = train(corpus, two, root)
    versions = saved_versions(spark, root)
    assert len(versions) == 2
    for _ in range(2):
        same(model, resume_training(corpus, two, root), rel=0)
    assert saved_versions(spark, root) == versions
    same(model, load_model(spark, root), rel=0)


def test_a_save_that_fails_leaves_the_version_before(spark, params, tmp_path, monkeypatch):
    root = str(tmp_path / "model")
    model = new_model(spark, params)
    save_model(model, root)

    def fail(_):
        raise RuntimeError("stopped between table and metadata")

    monkeypatch.setattr("themata.sources.models.meta_row", fail)
    with pytest.raises(RuntimeError, match="between"):
        save_model(model, root)
    same(model, load_model(spark, root), rel=0)


def test_a_table_with_missing_rows_is_not_loaded(spark, params, tmp_path):
    root = str(tmp_path / "model")
    old = save_model(new_model(spark, params), root)
    new = save_model(replace(old, num_updates=1, source=None), root)
    old.lam.limit(3).write.mode("overwrite").parquet(f"{new.source}/lambda")
    assert load_model(spark, root).num_updates == 0
    new.lam.limit(0).write.mode("overwrite").parquet(f"{old.source}/lambda")
    with pytest.raises(FileNotFoundError):
        load_model(spark, root)


def test_stored_table_is_reused(spark, params, tmp_path):
    path = str(tmp_path / "lambda")
    first = new_model(spark, replace(params, lambda_start="gamma"), path)
    again = new_model(spark, replace(params, init_lambda=False), path)
    same(first, again, rel=0)
    with pytest.raises(ValueError, match="stored"):
        new_model(spark, replace(params, init_lambda=False))


def test_ranking_floor(spark, params):
    model = new_model(spark, replace(params, tf_ranking_min=10))
    assert sorted(table(model)) == list(range(10, params.vocab_size))
    assert model.num_words == params.vocab_size - 10


def test_like_the_library_model(spark, corpus, params):
    """Spark's own online model on the same documents ends at a similar perplexity."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import SparseVector, VectorUDT

    size = params.vocab_size
    to_vector = F.udf(lambda i, c: SparseVector(size, i, c), VectorUDT())
    features = corpus.select(to_vector("word_ids", "word_cts").alias("features")).cache()
    theirs = LDA(
        k=5, maxIter=20, optimizer="online", subsamplingRate=0.3, learningOffset=8.0,
        learningDecay=0.7, topicConcentration=0.1, docConcentration=[0.2], seed=1,
        optimizeDocConcentration=False,
    ).fit(features)
    ours = train(corpus, replace(params, perplexity=False, lambda_start="gamma"))
    a, b = theirs.logPerplexity(features), evaluate(corpus, ours, params).value
    assert b == pytest.approx(a, rel=0.05)


@pytest.mark.parametrize(
    "changes, message",
    [
        ({"num_topics": 1}, "num_topics"),
        ({"alpha": (0.0,)}, "above 0"),
        ({"alpha": (0.1, 0.2)}, "alpha needs"),
        ({"eta": 0.0}, "eta"),
        ({"mini_batch_fraction": 0.0}, "fraction"),
        ({"max_inner_iter": 0}, "inner"),
        ({"tf_ranking_min": 10**9}, "ranking"),
        ({"gamma_start": "ones"}, "equal start"),
    ],
)
def test_parameter_checks(params, changes, message):
    with pytest.raises(ValueError, match=message):
        replace(params, **changes)


def test_prior_vector(params):
    assert params.alpha_vector() == pytest.approx([0.2] * 5)
    assert replace(params, alpha=(0.3,)).alpha_vector() == pytest.approx([0.3] * 5)
    own = (0.1, 0.2, 0.3, 0.4, 0.5)
    assert replace(params, alpha=own).alpha_vector() == pytest.approx(own)


def test_streamed_scores(spark, corpus, params, tmp_path):
    from themata.plans.score import score_topics
    from themata.streaming.scoring import read_cells, score_stream

    model = train(corpus, replace(params, max_outer_iter=2, perplexity=False))
    cells = C.corpus_to_cells(corpus).unionByName(
        spark.createDataFrame([(-1, "broken")], schemas.CELLS)
    )
    cells.repartition(6).write.parquet(str(tmp_path / "cells"))
    stream = read_cells(spark, str(tmp_path / "cells"), files_per_batch=2)
    query = score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check"), seed=1)
    query.awaitTermination(120)
    assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "out" / "topics"))
    assert found.select("batch").distinct().count() == 3
    want = {r["doc_id"]: r["cell"] for r in score_topics(corpus, model, seed=1).collect()}
    got = {r["doc_id"]: r["topic_idx"] for r in found.collect()}
    assert set(got) == set(want)
    assert spark.read.parquet(str(tmp_path / "out" / "corrupt")).first()["doc"] == "broken"


def test_command_lines(spark, corpus, params, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(Path(__file__).resolve().parents[1] / "apps"))
    import doc_topics
    import doc_words

    sys.modules.pop("train", None)
    import train as train_app

    C.corpus_to_cells(corpus).write.parquet(str(tmp_path / "cells"))
    model, topics, words = (str(tmp_path / n) for n in ("model", "topics", "words"))
    base = [
        "--corpus", str(tmp_path / "cells"), "--format", "cells", "--model", model,
        "--topics", "3", "--total-docs", str(params.total_docs),
        "--vocab-size", str(params.vocab_size), "--mini-batch", "60", "--eta", "0.1",
        "--decay", "8", "--partitions", "4",
    ]
    train_app.main([*base, "--iterations", "1"])
    train_app.main([*base, "--iterations", "2", "--continue", "true"])
    assert load_model(spark, model).num_updates == 2
    doc_topics.main(
        ["--corpus", str(tmp_path / "cells"), "--format", "cells", "--model", model,
         "--out", topics, "--quarantine", str(tmp_path / "bad")]
    )
    doc_words.main(["--topics", topics, "--model", model, "--out", words, "--from-cells"])
    assert spark.read.parquet(words).count() == spark.read.parquet(topics).count()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 0


def test_a_stored_split_is_kept(spark, corpus, tmp_path):
    path = str(tmp_path / "model" / "heldout")
    training, held = split_heldout(corpus, path, 20, 5)
    again, same_held = split_heldout(corpus, path, 50, 6)
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())
    assert len(ids(held)) == 20 and ids(held) == ids(same_held)
    assert ids(training) == ids(again) == sorted(set(ids(corpus)) - set(ids(held)))
    other, _ = split_heldout(corpus, str(tmp_path / "other"), 20, 6)
    assert ids(other) != ids(training)


def test_training_options_of_the_command_line(monkeypatch):
    monkeypatch.syspath_prepend(str(Path(__file__).resolve().parents[1] / "apps"))
    sys.modules.pop("train", None)
    import train as train_app

    base = ["--corpus", "c", "--model", "m", "--topics", "2", "--total-docs", "10", "--vocab-size", "5"]
    base += ["--mini-batch", "5", "--eta", "0.1"]
    usual = train_app.parameters(train_app.parse(base))
    assert usual == TopicParams(eta=0.1, mini_batch_fraction=0.5, vocab_size=5, num_topics=2, total_docs=10)
    more = [
        "--alpha", "0.1", "0.4", "--threshold", "0.01", "--max-inner-iter", "7", "--update-alpha", "true",
        "--lambda-start", "gamma", "--broadcast-bytes", "100", "--block-bytes", "200",
    ]
    params = train_app.parameters(train_app.parse(base + more))
    assert params.alpha == (0.1, 0.4) and params.convergence_threshold == 0.01
    assert params.max_inner_iter == 7 and params.optimize_doc_concentration
    assert (params.broadcast_bytes, params.block_bytes) == (100, 200)
    with pytest.raises(SystemExit):
        train_app.parse([*base, "--heldout", "h", "--heldout-docs", "3"])
