"""The weighted hash tree against a plain version and its laws."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from themata.llm.hash_tree import check_tree, descend, even_tree, read_shards, shard_documents, write_shards
from themata.llm.queries import op13_hash_tree

SF = "/root/testdata/sf0.001"


def plain(doc_id, tree):
    """Region by region, rack by rack, shard by shard."""

    def arrival(number, weight):
        key = "" if doc_id is None else str(doc_id)
        u = int(hashlib.md5(f"{key}@{number}".encode()).hexdigest()[:13], 16) / 2**52
        return -math.log(1 - u) / weight

    earliest = lambda rack: min(arrival(*s) for s in rack)
    region = min(tree, key=lambda g: min(map(earliest, g)))
    rack = min(region, key=earliest)
    return min(rack, key=lambda s: arrival(*s))[0]


def shards_of(spark, n, tree):
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    rows = ids.select("doc_id", descend(F.col("doc_id"), tree)["shard"].alias("s")).collect()
    return {r["doc_id"]: r["s"] for r in rows}


def test_query_against_the_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_hash_tree(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == plain(r["doc_id"], even_tree(16))
        assert r["grown_shard"] == plain(r["doc_id"], even_tree(17))
        assert r["grown_shard"] in (r["shard"], 16)
    places = sorted((r["shard"], r["slot"]) for r in rows)
    sizes = Counter(s for s, _ in places)
    assert places == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]


def test_weights_are_met(spark):
    tree = [[[(0, 1.0), (1, 2.0)], [(2, 1.0)]], [[(3, 4.0)]]]
    found = Counter(shards_of(spark, 20000, tree).values())
    for shard, share in ((0, 1 / 8), (1, 2 / 8), (2, 1 / 8), (3, 4 / 8)):
        assert found[shard] / 20000 == pytest.approx(share, abs=0.015)


@pytest.mark.parametrize("n", [1, 3, 4, 7, 8, 16])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    old, new = (shards_of(spark, 2000, even_tree(k)) for k in (n, n + 1))
    moved = {i for i in old if old[i] != new[i]}
    assert moved and {new[i] for i in moved} == {n}


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    old = [[[(0, 1.0), (1, 1.0)], [(2, 1.0), (3, 1.0)]], [[(4, 1.0), (5, 1.0)]]]
    new = [[[(0, 1.0), (1, 1.0)], [(2, 3.0), (3, 1.0)]], [[(4, 1.0), (5, 1.0)]]]
    a, b = shards_of(spark, 3000, old), shards_of(spark, 3000, new)
    assert {b[i] for i in a if a[i] != b[i]} == {2}
    # The other way round, rows leave only the shard that lost weight.
    assert {a[i] for i in a if a[i] != b[i]} <= {0, 1, 3, 4, 5}


def test_trees_are_checked():
    assert [len(g) for g in even_tree(17)] == [2, 2, 1]
    for bad in ([], [[[(0, 1.0), (0, 1.0)]]], [[[(0, 0.0)]]], [[[(0, math.inf)]]]):
        with pytest.raises(ValueError):
            check_tree(bad)


def test_odd_rows_and_names(spark, odd, tmp_path):
    docs = odd.withColumns({n: F.lit(n) for n in ("shard", "slot", "row", "region", "lane", "place", "task", "at")})
    rows = shard_documents(docs, str(tmp_path / "a")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert Counter(r["size"] for r in rows) == Counter(len((r[1] or "").encode()) + 1 for r in ODD)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(ODD)
    held = read_shards(spark, str(tmp_path / "a")).select("row.*").collect()
    assert {r["place"] for r in held} == {"place"} and len(held) == len(ODD)
    empty = shard_documents(docs.limit(0), str(tmp_path / "b"))
    assert empty.columns == shard_documents(docs, str(tmp_path / "c")).columns
    assert empty.count() == 0


def test_a_large_shard_has_several_files_and_slots_without_gaps(spark, tmp_path):
    # One id holds a third of all rows.
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("a text").alias("text")
    ).repartition(6)
    write_shards(docs, even_tree(2), str(tmp_path / "s"), file_bytes=2000)
    rows = read_shards(spark, str(tmp_path / "s")).collect()
    by_shard = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in (0, 1)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    assert sum(map(len, by_shard.values())) == 3000
    lanes = spark.read.parquet(str(tmp_path / "s")).groupBy("shard", "lane").count().collect()
    assert len(lanes) > 6 and max(r["count"] for r in lanes) < 1500
