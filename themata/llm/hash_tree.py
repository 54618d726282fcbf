"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

Every shard draws for every document: an exponential arrival time whose rate is the shard's weight,
from a hash of document id and shard number. The draw of a rack is the earliest of its shards and that
of a region the earliest of its racks, so each is an exponential draw with the weight of the whole
subtree. A document descends from the root: to the region with the earliest draw, there to the rack
and there to the shard.

Only the document id and the tree decide. A draw changes only with the weight of its own shard, so
the draw of a subtree changes only if weights below it do: documents enter or leave only subtrees
whose weights change, and a new shard, wherever it stands in the tree, takes documents only into
itself. (Draws made anew on each level would not do: a document that enters a region because one
shard was added there could go on to any other shard of that region.)
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themata.llm.common import text_of

SHARDS = 16
SHARDS_A_RACK, RACKS_A_REGION = 4, 2
#: Bytes of text in a file of a shard, about.
FILE_BYTES = 256 << 20
#: Files whose row counts, 24 bytes each, may be broadcast.
MOST_BROADCAST_FILES = 1 << 18
#: The row number within a task, in the ids that Spark numbers rows by.
ROW_BITS = 33

#: A tree: regions of racks of (shard number, weight).
Rack = Sequence[tuple[int, float]]
Region = Sequence[Rack]
Tree = Sequence[Region]


def even_tree(
    shards: int, a_rack: int = SHARDS_A_RACK, a_region: int = RACKS_A_REGION, weight: float = 1.0
) -> Tree:
    """Shards 0 .. n - 1 of equal weight, in racks and regions that are filled one after the other."""
    numbers = [(n, weight) for n in range(shards)]
    racks = [numbers[at : at + a_rack] for at in range(0, shards, a_rack)]
    return [racks[at : at + a_region] for at in range(0, len(racks), a_region)]


def check_tree(tree: Tree) -> list[int]:
    """The shard numbers of a tree, which have to differ and to have weights above 0."""
    shards = [s for region in tree for rack in region for s in rack]
    numbers = [n for n, _ in shards]
    if not numbers or len(set(numbers)) < len(numbers):
        raise ValueError("a tree has at least one shard, and each number once")
    if any(not (w > 0 and math.isfinite(w)) for _, w in shards):
        raise ValueError("weights are finite and above 0")
    return numbers


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """The arrival time of a key at a shard: exponential, with the weight as its rate."""
    digest = F.md5(F.concat(key, F.lit("@"), shard.cast("string")).cast("binary"))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return -F.log(F.lit(1.0) - uniform) / weight


def descend(doc_id: Column, tree: Tree) -> Column:
    """struct(draw, region, rack, shard) of the leaf that a document reaches; racks count in their region."""
    check_tree(tree)
    key = F.coalesce(doc_id.cast("string"), F.lit(""))

    def leaf(region: int, rack: int, shard: tuple[int, float]) -> Column:
        number, weight = shard
        return F.struct(*[F.lit(v) for v in (region, rack, number)], F.lit(float(weight)))

    def arrival(node: Column) -> Column:
        at = draw(key, node["col3"], node["col4"])
        names = zip(("col1", "col2", "col3"), ("region", "rack", "shard"), strict=True)
        return F.struct(at.alias("draw"), *[node[old].alias(new) for old, new in names])

    racks = [
        [F.array(*[leaf(g, r, s) for s in rack]) for r, rack in enumerate(region)]
        for g, region in enumerate(tree)
    ]
    regions = F.array(*[F.array(*region) for region in racks])
    of_rack = lambda shards: F.array_min(F.transform(shards, arrival))
    of_region = lambda region: F.array_min(F.transform(region, of_rack))
    return F.array_min(F.transform(regions, of_region))


def place(docs: DataFrame, tree: Tree) -> DataFrame:
    """``(region, rack, shard, row)`` with each row of ``docs`` as the struct ``row``."""
    held = docs.select(F.struct("*").alias("row"))
    placed = held.select(descend(F.col("row.doc_id"), tree).alias("at"), "row")
    return placed.select("at.region", "at.rack", "at.shard", "row")


def write_shards(docs: DataFrame, tree: Tree, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write all documents by shard: ``shard=<n>/``, one row per document, and its place.

    The columns of ``docs`` are kept in the struct ``row``, whatever their names are. One shuffle
    brings each shard's rows to as many tasks as its bytes need, dealt by the task they come from:
    equal ids, null ids and copies are spread like all others.
    """
    numbers = check_tree(tree)
    total = docs.select(F.octet_length(text_of()).alias("n")).agg(F.sum("n")).first()[0] or 0
    lanes = max(1, math.ceil(total / len(numbers) / file_bytes))
    index = F.array_position(F.array(*[F.lit(n) for n in numbers]), F.col("shard")) - 1
    lane = F.pmod(F.spark_partition_id(), F.lit(lanes))
    row_number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    (
        place(docs, tree)
        .withColumn("lane", lane)
        .withColumn("task", (index * F.lit(lanes) + F.col("lane")).cast("int"))
        .repartitionById(len(numbers) * lanes, "task")
        .drop("task")
        # A task has the rows of one shard, so its row numbers have no gaps.
        .withColumn("place", row_number)
        .write.partitionBy("shard")
        .parquet(folder)
    )


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard, region, rack, slot, row)``: the written rows, numbered from 0 in each shard."""
    rows = spark.read.parquet(folder)
    counts = rows.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    bases = counts.select("shard", "lane", first.alias("base"))
    # One row per file at most; beyond the bound Spark joins by shuffle.
    if len(rows.inputFiles()) <= MOST_BROADCAST_FILES:
        bases = F.broadcast(bases)
    joined = rows.join(bases, ["shard", "lane"])
    slot = (F.col("base") + F.col("place")).alias("slot")
    return joined.select(F.col("shard").cast("int").alias("shard"), "region", "rack", slot, "row")


def shard_documents(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Write documents to shards of equal weight and list where each one is.

    Returns doc_id, size (bytes of the text plus 1), text_crc32, law (``key``), shard, slot,
    grown_shard (with one more shard), region and rack, all read back from the written shards. Null text
    is the empty text. A null id is the key "". Rows of equal ids are in the same shard, each with a
    slot of its own; no row is dropped. Other columns go into the shards, under any name. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    write_shards(docs, even_tree(shards), folder)
    if not docs.take(1):
        schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long"
        return spark.createDataFrame([], f"{schema}, grown_shard int, region int, rack int")
    rows = read_shards(spark, folder)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return rows.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        descend(F.col("row.doc_id"), even_tree(shards + 1))["shard"].alias("grown_shard"),
        "region",
        "rack",
    )
