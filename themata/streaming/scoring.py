"""Scoring documents as they arrive: bounded batches of an encoded corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from themata import schemas
from themata.functions.codecs import decode_bow
from themata.model import TopicModel
from themata.plans.score import score_topics


def read_cells(spark: SparkSession, path: str, files_per_batch: int = 50) -> DataFrame:
    """A stream of ``(doc_id, doc)`` cells from files that appear under ``path``."""
    return (
        spark.readStream.schema(schemas.CELLS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def score_stream(
    cells: DataFrame,
    model: TopicModel,
    out: str,
    checkpoint: str,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Write topic distributions to ``out/topics`` and malformed cells to ``out/corrupt``.

    Each batch is an ordinary table, so every layout of the E-step can serve it. A
    batch has a folder of its own that a repeated attempt overwrites, so a restart
    neither loses nor doubles documents.
    """

    def write(batch: DataFrame, number: int) -> None:
        decoded = decode_bow(batch)
        good = decoded.where("NOT corrupt").select("doc_id", "word_ids", "word_cts")
        score_topics(good, model, **options).write.mode("overwrite").parquet(
            f"{out}/topics/batch={number}"
        )
        decoded.where("corrupt").select("doc_id", "doc").write.mode("overwrite").parquet(
            f"{out}/corrupt/batch={number}"
        )

    writer = cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
