"""Training by mini-batches, and resuming from a saved model."""

from __future__ import annotations

import time
from contextlib import ExitStack
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from themata.model import TopicModel
from themata.operators.alpha import update_alpha
from themata.operators.bound import log_perplexity
from themata.operators.estep import e_step
from themata.operators.kernel import InferenceSpec
from themata.operators.sampling import BatchWindow, DirectBatches
from themata.operators.topictable import store_rows
from themata.operators.topicword import lambda_sums, peak_median, start_lambda, word_range
from themata.params import TopicParams
from themata.sources.metrics import append_metrics
from themata.sources.models import (
    load_model,
    read_lambda,
    save_lambda,
    save_model,
    stored_lambda,
)
from themata.storage import drop_table, new_folder, write_table

# Iterations whose metrics are appended as one file.
METRIC_ROWS = 64


def new_model(
    spark: SparkSession, params: TopicParams, lambda_path: str | None = None
) -> TopicModel:
    """A model before its first update.

    The table starts anew, unless ``init_lambda`` is off: then the stored table at
    ``lambda_path`` is used as it is.
    """
    if params.init_lambda:
        words = word_range(spark, params.tf_ranking_min, params.vocab_size, params.partitions)
        lam = start_lambda(words, params.num_topics, params.lambda_start, params.seed)
        if lambda_path:
            save_lambda(lam, lambda_path)
            lam = read_lambda(spark, lambda_path)
    elif lambda_path:
        lam = read_lambda(spark, lambda_path)
    else:
        raise ValueError("init_lambda is off: give the path of a stored topic-word table")
    return model_of(lam, params)


def model_of(lam: DataFrame, params: TopicParams, num_updates: int = 0) -> TopicModel:
    """A model around a given topic-word table."""
    return TopicModel(
        lam=lam.select("word_id", "lambda"),
        alpha=params.alpha_vector(),
        eta=params.eta,
        num_updates=num_updates,
        num_topics=params.num_topics,
        total_docs=params.total_docs,
        num_words=lam.count(),
        lambda_sum=lambda_sums(lam),
    )


def inference_spec(model: TopicModel, params: TopicParams, iteration: int) -> InferenceSpec:
    return InferenceSpec(
        alpha=model.alpha,
        lambda_sum=model.lambda_sum,
        threshold=params.convergence_threshold,
        max_steps=params.max_inner_iter,
        seed=params.seed,
        iteration=iteration,
        gamma_start=params.gamma_start,
    )


def _sizes(params: TopicParams) -> dict[str, int]:
    return {"broadcast_bytes": params.broadcast_bytes, "block_bytes": params.block_bytes}


def trainable(model: TopicModel, params: TopicParams, path: str) -> TopicModel:
    """The model with its table in buckets, written to ``path`` unless it has them already.

    A table within the broadcast limit is held on the driver as well.
    """
    table, limit = model.table, params.broadcast_bytes
    if table is None:
        held = limit if model.table_bytes <= limit else 0
        table = store_rows(model.lam, params.partitions, model.num_topics, path, held)
    else:
        # What another run has written stays.
        table = replace(table, paths=()).hold(model.num_topics, limit)
    return replace(model, lam=table.lam(), table=table, lambda_sum=table.lambda_sums())


def update(
    model: TopicModel, batch: DataFrame, batch_docs: int, params: TopicParams, path: str
) -> tuple[TopicModel, int]:
    """One iteration on a drawn batch: the new model, with what it writes under ``path``, and the
    number of modelled words in the batch."""
    iteration = model.num_updates + 1
    rho = params.step_size(iteration)
    if model.table is None:
        model = trainable(model, params, f"{path}/start")
    spec = inference_spec(model, params, iteration)
    want = "both" if params.optimize_doc_concentration else "stats"
    alpha = model.alpha
    with ExitStack() as resources:
        result = e_step(batch, model, spec, want, **_sizes(params), resources=resources)
        if want == "both":
            folder = new_folder(batch.sparkSession, "estep")
            resources.callback(drop_table, batch.sparkSession, folder)
            result = write_table(result, folder)
            alpha = update_alpha(alpha, result.where("doc_id IS NOT NULL"), rho)
            result = result.where("word_id IS NOT NULL")
        table, words = model.table.add(
            result, rho, model.eta, model.total_docs / batch_docs, path
        )
    new = replace(
        model,
        lam=table.lam(),
        alpha=alpha,
        num_updates=iteration,
        lambda_sum=table.lambda_sums(),
        source=None,
        table=table,
    )
    return new, words


def next_window(
    corpus: DataFrame, params: TopicParams, first: int
) -> BatchWindow | DirectBatches:
    fraction = params.mini_batch_fraction
    last = first + BatchWindow.size(fraction, params.batches_per_scan) - 1
    last = min(last, params.max_outer_iter)
    if fraction >= DirectBatches.LEAST_FRACTION:
        return DirectBatches(corpus, fraction, params.seed, first, last)
    return BatchWindow(corpus, fraction, params.seed, first, last, params.total_docs)


def train(
    corpus: DataFrame,
    params: TopicParams,
    root: str | None = None,
    heldout: DataFrame | None = None,
    model: TopicModel | None = None,
) -> TopicModel:
    """Train for ``max_outer_iter`` iterations in all, and save the model under ``root``.

    ``corpus`` should be a stored table: it is scanned once per window of batches, or once per
    iteration if those are a large share of it. An iteration writes the rows of the words that its
    batch touches to the shared folder, which ends their lineage; what is merged or saved since is
    removed again.
    """
    spark = corpus.sparkSession
    if model is None:
        model = new_model(spark, params)
    work = new_folder(spark, "train")
    with ExitStack() as resources:
        # Whatever ends the loop, its last window goes.
        windows: list[BatchWindow | DirectBatches] = []
        resources.callback(lambda: [w.drop() for w in windows])
        model, log = _iterate(corpus, params, root, heldout, model, work, windows)
    if root:
        append_metrics(spark, f"{root}/metrics", log)
        model = _saved(model, root)
    return model


def _saved(model: TopicModel, root: str) -> TopicModel:
    """The model saved under ``root``, with that save as its table; deltas go."""
    spark = model.lam.sparkSession
    model = save_model(model, root)
    old = model.table
    if old is None:
        return model
    lam, table = stored_lambda(spark, model.source, old.buckets, model.num_words, model.lambda_sum)
    for path in old.paths:
        drop_table(spark, path)
    held = old.held_lambda() if old.held is not None else None
    return replace(model, lam=lam, table=replace(table, held=held))


def _iterate(
    corpus: DataFrame,
    params: TopicParams,
    root: str | None,
    heldout: DataFrame | None,
    model: TopicModel,
    work: str,
    windows: list[BatchWindow | DirectBatches],
) -> tuple[TopicModel, list[tuple[int, str, float]]]:
    """The iterations of ``train``: the model and metrics not yet written.

    ``windows`` holds the window of batches in use, if any.
    """
    spark = corpus.sparkSession
    log: list[tuple[int, str, float]] = []
    if model.num_updates < params.max_outer_iter:
        model = trainable(model, params, f"{work}/start")
    while model.num_updates < params.max_outer_iter:
        began = time.monotonic()
        iteration = model.num_updates + 1
        if not windows or iteration > windows[0].last:
            if windows:
                windows.pop().drop()
            windows.append(next_window(corpus, params, iteration))
        window = windows[0]
        batch_docs = window.docs.get(iteration, 0)
        if batch_docs:
            batch = window.batch(iteration)
            model, words = update(model, batch, batch_docs, params, f"{work}/{iteration}")
        else:
            model, words = replace(model, num_updates=iteration, source=None), 0
        if (
            params.perplexity
            and heldout is not None
            and iteration % params.perplexity_freq == 0
        ):
            value = evaluate(heldout, model, params).value
            log.append((iteration, "log_perplexity", value))
        if root and iteration % params.check_point_freq == 0:
            model = _saved(model, root)
            log.append((iteration, "peak_median", peak_median(model.lam).first()[0]))
        log.append((iteration, "batch_docs", batch_docs))
        log.append((iteration, "batch_words", words))
        log.append((iteration, "seconds", time.monotonic() - began))
        # With each checkpoint, so that a job that dies loses no metrics of what it saved.
        if root and (len(log) >= METRIC_ROWS or iteration % params.check_point_freq == 0):
            append_metrics(spark, f"{root}/metrics", log)
            log = []
    return model, log


def evaluate(heldout: DataFrame, model: TopicModel, params: TopicParams):
    """Held-out perplexity of the current model."""
    spec = inference_spec(model, params, model.num_updates)
    with ExitStack() as resources:
        return log_perplexity(
            heldout, model, spec, params.tf_ranking_min, **_sizes(params), resources=resources
        )


def resume_training(
    corpus: DataFrame, params: TopicParams, root: str, heldout: DataFrame | None = None
) -> TopicModel:
    """Continue from the newest saved model up to ``max_outer_iter`` iterations.

    Prior, eta and the update count are those of the saved model.
    """
    model = load_model(corpus.sparkSession, root)
    if model.num_topics != params.num_topics:
        raise ValueError(f"the saved model has {model.num_topics} topics")
    if not np.isclose(model.eta, params.eta, rtol=0, atol=0):
        raise ValueError(f"the saved model has eta {model.eta}, not {params.eta}")
    if model.total_docs != params.total_docs:
        model = replace(model, total_docs=params.total_docs, source=None)
    return train(corpus, params, root, heldout, model)
