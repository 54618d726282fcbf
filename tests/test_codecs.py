from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from themata.functions.codecs import decode_bow, decode_distribution
from themata.sources.corpus import (
    corpus_from_cells,
    corpus_to_cells,
    corrupt_cells,
    explode_documents,
    topic_distributions,
)

BOW = [
    ("10:7:3,2:1:4.5", [10, 7, 3], [2.0, 1.0, 4.5]),
    ("5,1", [5], [1.0]),
    ("1:2:3,4:5", [1, 2], [4.0, 5.0]),
    ("1:2,3:4:5", [1, 2], [3.0, 4.0]),
    ("1:2", None, None),
    ("1:2,", None, None),
    ("1:2:,3:4:", [1, 2], [3.0, 4.0]),
    ("1:x,2:3", None, None),
    ("1:2,3:y", None, None),
    ("1:5.0,2:3", None, None),
    ("1::2,3:4:5", None, None),
    ("", None, None),
    (",1", None, None),
    ("1:2,3:4,9", [1, 2], [3.0, 4.0]),
    (":,1", [], []),
    ("99999999999999999999,1", None, None),
    (None, None, None),
]


def test_bow_cells(spark):
    frame = spark.createDataFrame(
        [(i, c) for i, (c, _, _) in enumerate(BOW)], "doc_id BIGINT, doc STRING"
    )
    rows = {r["doc_id"]: r for r in decode_bow(frame).collect()}
    for i, (cell, ids, counts) in enumerate(BOW):
        assert rows[i]["corrupt"] == (ids is None), cell
        assert rows[i]["word_ids"] == ids, cell
        assert rows[i]["word_cts"] == counts, cell
    good, bad = corpus_from_cells(frame).count(), corrupt_cells(frame).count()
    assert good + bad == len(BOW) and bad == sum(ids is None for _, ids, _ in BOW)


@pytest.mark.parametrize(
    "cell, ids, probs",
    [
        ("0,3:0.625,0.375", [0, 3], [0.625, 0.375]),
        ("0,0:0.4,0.6", [0], [0.6]),
        ("2,0,2:0.1,0.2,0.7", [0, 2], [0.2, 0.7]),
        (":", None, None),
        ("1:", None, None),
        ("a:1", None, None),
    ],
)
def test_topic_cells(spark, cell, ids, probs):
    frame = spark.createDataFrame([(1, cell)], "doc_id BIGINT, cell STRING")
    row = decode_distribution(frame).first()
    assert row["corrupt"] == (ids is None)
    assert row["topic_idx"] == ids and row["prob"] == probs
    assert topic_distributions(frame).count() == (ids is not None)


def test_round_trip(spark):
    rows = [(1, [3, 5], [1.0, 2.5]), (2, [9], [1e-7])]
    corpus = spark.createDataFrame(
        rows, "doc_id BIGINT, word_ids ARRAY<BIGINT>, word_cts ARRAY<DOUBLE>"
    )
    back = corpus_from_cells(corpus_to_cells(corpus)).orderBy("doc_id").collect()
    assert [tuple(r) for r in back] == rows


def test_explode_cuts_the_longer_array(spark):
    corpus = spark.createDataFrame(
        [(1, [3, 5, 7], [1.0, 2.0])], "doc_id BIGINT, word_ids ARRAY<BIGINT>, word_cts ARRAY<DOUBLE>"
    )
    found = explode_documents(corpus).orderBy(F.col("word_id")).collect()
    assert [tuple(r) for r in found] == [(1, 3, 1.0), (1, 5, 2.0)]


def test_cells_by_rising_id_are_not_sorted(spark, tmp_path):
    """The same numbers by rising and by falling id; only the latter have to be put in order."""
    ids, probs = list(range(150_000)), [(i % 97 + 1) / 1e7 for i in range(150_000)]
    cell = lambda step: ",".join(map(str, ids[::step])) + ":" + ",".join(map(str, probs[::step]))
    taken, found = {1: [], -1: []}, {}
    for step in taken:
        spark.createDataFrame([(d, cell(step)) for d in range(4)], "doc_id long, cell string").write.parquet(f"{tmp_path}/{step}")
    for _ in range(4):
        for step in taken:
            read = decode_distribution(spark.read.parquet(f"{tmp_path}/{step}"), id_type="bigint")
            began = time.perf_counter()
            read.write.format("noop").mode("overwrite").save()
            taken[step].append(time.perf_counter() - began)
            found[step] = read.first()
    for row in found.values():
        assert row["topic_idx"] == ids and row["prob"] == probs and not row["corrupt"]
    assert min(taken[1]) < 0.7 * min(taken[-1])
