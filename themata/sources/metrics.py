"""The table of training metrics: ``(iter, metric, value)``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from themata import schemas


def append_metrics(spark: SparkSession, path: str, rows: list[tuple[int, str, float]]) -> None:
    if rows:
        iters, names, values = zip(*rows)
        table = pa.table(
            {
                "iter": pa.array(iters, pa.int32()),
                "metric": pa.array(names),
                "value": pa.array(values, pa.float64()),
            }
        )
        spark.createDataFrame(table).coalesce(1).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).parquet(path)
