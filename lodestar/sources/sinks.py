"""Writers: every one is a Spark job, atomic by its committer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(rows: DataFrame, path: str) -> None:
    """Index rows by kind, sorted by document inside, so a filter on either prunes files or row groups."""
    rows.repartition("kind", F.pmod(F.xxhash64("doc_id"), F.lit(64))).sortWithinPartitions("doc_id", "section_id").write.mode("overwrite").partitionBy("kind").parquet(path)


def lines(requests: DataFrame, path: str) -> None:
    """JSON lines of (batch, line), a folder per batch."""
    requests.select("batch", F.col("line").alias("value")).write.mode("overwrite").partitionBy("batch").text(path)


def failures(rows: DataFrame, path: str) -> None:
    """A table of failures, written even if there are none: an absent one would mean that nothing ran."""
    table(rows, path)


def layout(rows: DataFrame, path: str) -> None:
    """The side table of element places, by document."""
    rows.repartition("doc_id").sortWithinPartitions("doc_id", "section_id").write.mode("overwrite").parquet(path)


def populated(rows: DataFrame, ledger: DataFrame, path: str, ledger_path: str) -> None:
    """The index, and then the ledger of what is in it: a run that ends between the two is done again."""
    index(rows, path)
    table(ledger, ledger_path)


def table(rows: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    rows.write.mode(mode).partitionBy(*by).parquet(path)
