"""Dense ids in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themata.storage import materialise

# monotonically_increasing_id() keeps the row number in the low 33 bits.
ROW_BITS = 33


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, ... in ``order``, which has to be a total order.

    The range-partitioned sort is written once, so that the partition sizes and
    the numbered rows come from the same partitions. Only the sizes, one row per
    partition, are summed up in one task.
    """
    ordered = materialise(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    )
    part = F.shiftright("_at", ROW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row per partition of the sort: safe to broadcast.
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_part", "_at", "_off")
    )
