"""Bags of words are counted in slices of bounded size."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from themata.sources import corpus as C


def test_slices_are_bounded_by_tokens():
    lists = [["a"] * n for n in (3, 0, 4, 9, 1, 2, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists)], names=["doc_id", "tokens"])
    for part in (batch, batch.slice(1)):
        slices = list(C._slices(part, 7))
        assert pa.Table.from_batches(slices).column("tokens").to_pylist() == part.column(1).to_pylist()
        assert all(s.num_rows == 1 or len(s.column(1).flatten()) <= 7 for s in slices)
        assert len(slices) < 5
    assert list(C._slices(batch.slice(0, 0), 7)) == []


def test_documents_of_any_length(spark):
    rows = [(1, "aaa bbb aaa"), (2, None), (3, "ccc " * (C.SLICE_TOKENS + 5)), (4, "aaa")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1)
    found = {r["doc_id"]: {w["word"]: w["cnt"] for w in r["bag"]} for r in C.bags_of_words(docs).collect()}
    assert found == {1: {"aaa": 2, "bbb": 1}, 2: {}, 3: {"ccc": C.SLICE_TOKENS + 5}, 4: {"aaa": 1}}


def test_tokens_of_odd_texts(spark):
    """Tokens are those of Spark's own split, in slices that begin anywhere."""
    texts = ["", "ab", "abc", "xabc", "Zürich ABCdKelvin İstanbul", "aaa\nbbb", "éabcé", "a" * 70, "abc-", " ", "ab cd", "日本abc語def"]
    for part in (pa.array(texts), pa.array(texts).slice(3), pa.array(texts, pa.large_string()).slice(1, 5), pa.array([], pa.string())):
        lower = pa.array([t.lower() for t in ["", *part.to_pylist()]], part.type).slice(1)
        found, rows = C.letter_runs(lower)
        assert list(zip(rows.tolist(), found.to_pylist(), strict=True)) == [
            (i, w) for i, t in enumerate(lower.to_pylist()) for w in re.findall("[a-z]{3,}", t)
        ]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id BIGINT, text STRING")
    split = docs.select("doc_id", F.explode(C.tokens(F.coalesce("text", F.lit("")))).alias("word"))
    plain = {(r["doc_id"], r["word"], r["count"]) for r in split.groupBy("doc_id", "word").count().collect()}
    assert {tuple(r) for r in C.word_counts(C.bags_of_words(docs)).collect()} == plain


def test_tokens_are_not_sent_as_lists(spark):
    """Texts go to the counting step as they are, not cut into lists of strings by a lambda."""
    docs = spark.createDataFrame([(1, "aaa")], "doc_id BIGINT, text STRING")
    plan = C.bags_of_words(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
