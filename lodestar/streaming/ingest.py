"""Incremental indexing as a stream of files (an extension: the reference only resumes batches)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import deltas
from ..sources.deltas import current

__all__ = ["current", "ingest"]


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, rows: Callable[[DataFrame], DataFrame], index: str, owner: list[str], records: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Index every document file that has come since the last run, then stop.

    The checkpoint stands for the ledger: a file is taken once. Each batch adds
    its rows to the index (``deltas``) with the owners of the new rows replaced,
    and writes no more than them; the batch's number goes into the manifest, so
    a batch that is run again after a crash changes nothing. A batch that is cut
    off leaves the last index whole. The index is compacted when that pays.
    ``records`` makes the ledger's rows of a batch's documents.
    """

    def take(batch: DataFrame, number: int) -> None:
        done = deltas.upserted(spark, index, rows(batch), owner, None if records is None else records(batch), (checkpoint, number))
        if done.due:
            deltas.compacted(spark, index, owner)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
