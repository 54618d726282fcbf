from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from themata.operators.ranking import dense_ids
from themata.operators.sampling import draw_minibatch, heldout_draw
from themata.operators.topicword import join_lambda, rows_of_words, start_lambda, word_range
from themata.sources import corpus as C

TEXTS = {
    1: "The cat, the CAT and the dog.",
    2: "a an to",
    3: "dog dog_dog 42 bird",
    4: "",
    5: "the " * 500 + "zebra",
    6: None,
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id BIGINT, text STRING")


def plain_counts():
    out = {}
    for doc, text in TEXTS.items():
        words = [w for w in re.split("[^a-z]+", (text or "").lower()) if len(w) >= 3]
        out |= {(doc, w): n for w, n in Counter(words).items()}
    return out


def test_counts(documents):
    found = C.word_counts(C.bags_of_words(documents)).collect()
    assert {(r["doc_id"], r["word"]): r["cnt"] for r in found} == plain_counts()


def test_vocabulary(documents):
    bags = C.bags_of_words(documents)
    rows = C.vocabulary(bags).orderBy("word_id").collect()
    assert [r["word_id"] for r in rows] == list(range(len(rows)))
    assert rows[0]["word"] == "the" and rows[0]["tf"] == 503 and rows[0]["df"] == 2
    assert [(-r["tf"], r["word"]) for r in rows] == sorted((-r["tf"], r["word"]) for r in rows)
    assert {r["word"] for r in C.vocabulary(bags, min_df=2).collect()} == {"the", "dog"}


@pytest.mark.parametrize("limit", [1 << 20, 300, 1])
def test_encoding_does_not_depend_on_the_broadcast_limit(documents, limit):
    bags = C.bags_of_words(documents)
    vocab = C.vocabulary(bags)
    ids = {r["word"]: r["word_id"] for r in vocab.collect()}
    found = C.encode_words(C.word_counts(bags), vocab, limit).collect()
    assert {(r["doc_id"], r["word_id"]): r["cnt"] for r in found} == {
        (d, ids[w]): float(n) for (d, w), n in plain_counts().items()
    }
    assert len(found) == len(plain_counts())


def test_corpus_from_text(documents):
    vocab = C.vocabulary(C.bags_of_words(documents))
    rows = {r["doc_id"]: r for r in C.corpus_from_text(documents, vocab).collect()}
    assert set(rows) == {1, 3, 5}
    for row in rows.values():
        assert row["word_ids"] == sorted(row["word_ids"])
    assert sum(rows[5]["word_cts"]) == 501


def test_first_seen(documents):
    found = {r["word"]: r["vocab_id"] for r in C.first_seen_words(documents).collect()}
    assert found == {"the": 0, "cat": 1, "and": 2, "dog": 3, "bird": 4, "zebra": 5}


def test_dense_ids_over_many_partitions(spark):
    frame = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v"))
    rows = dense_ids(frame.repartition(16), [F.desc("v")], "n").collect()
    values = sorted((r["v"] for r in rows), reverse=True)
    assert {r["n"]: r["v"] for r in rows} == dict(enumerate(values))


def test_document_batches(spark):
    corpus = spark.range(120).select(F.col("id").alias("doc_id"))
    rows = {r["doc_id"]: r["batch"] for r in C.document_batches(corpus, 50).collect()}
    in_order = sorted(rows, key=str)
    assert [rows[d] for d in in_order] == [i // 50 for i in range(120)]


def test_minibatch(spark):
    corpus = spark.range(20000).select(
        F.col("id").alias("doc_id"),
        F.array(F.lit(1).cast("bigint")).alias("word_ids"),
        F.array(F.lit(2.0)).alias("word_cts"),
    )
    batch = draw_minibatch(corpus, 0.5, 3, 1)
    rows = {r["doc_id"]: (r["draws"], r["word_cts"]) for r in batch.collect()}
    assert sum(d for d, _ in rows.values()) == pytest.approx(10000, rel=0.03)
    assert max(d for d, _ in rows.values()) > 1
    assert all(c == [2.0 * d] and d > 0 for d, c in rows.values())
    again = draw_minibatch(corpus.repartition(3), 0.5, 3, 1).collect()
    assert {r["doc_id"]: (r["draws"], r["word_cts"]) for r in again} == rows
    other = draw_minibatch(corpus, 0.5, 3, 2).select("doc_id").collect()
    assert {r["doc_id"] for r in other} != set(rows)


def test_heldout_draw(spark):
    corpus = spark.range(500).select(F.col("id").alias("doc_id"))
    first = {r["doc_id"] for r in heldout_draw(corpus, 40, 1).collect()}
    assert len(first) == 40
    assert first == {r["doc_id"] for r in heldout_draw(corpus.repartition(5), 40, 1).collect()}
    assert first != {r["doc_id"] for r in heldout_draw(corpus, 40, 2).collect()}


def test_topic_word_rows(spark):
    lam = start_lambda(word_range(spark, 5, 25, 3), 4)
    assert lam.count() == 20 and lam.first()["lambda"] == [1.0] * 4
    words = spark.createDataFrame([(4,), (5,), (24,), (25,)], "word_id BIGINT")
    assert {r["word_id"] for r in rows_of_words(lam, words).collect()} == {5, 24}
    drawn = start_lambda(word_range(spark, 5, 25, 3), 4, "gamma", 1)
    again = start_lambda(word_range(spark, 5, 25, 7), 4, "gamma", 1)
    assert sorted(drawn.collect()) == sorted(again.collect())


def test_join_with_a_hot_word(spark):
    """Word 0 holds a third of the rows; both ways of the join give the inner join."""
    lam = start_lambda(word_range(spark, 0, 50, 2), 2, "gamma", 1)
    bow = spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 60).alias("word_id"),
        F.lit(1.0).alias("cnt"),
    )
    plain = sorted(bow.join(lam, "word_id").select("doc_id", "word_id", "cnt", "lambda").collect())
    for limit in (16, 160, 1 << 20):
        assert sorted(join_lambda(bow, lam, 2, limit).collect()) == plain
