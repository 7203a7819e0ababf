"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
BLANKS = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but in local mode
    only: on a cluster nobody else could see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lodestar-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A run whose intermediate tables go at its end: write what the operators return inside of it."""
    mine: list[str] = []
    _OPEN.append(mine)
    try:
        yield
    finally:
        _OPEN.remove(mine)
        for path in mine:
            spark.sql(f"drop table if exists {_table_name(path)}")
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


#: Spark's setting by which a statement's shuffle files go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Statements whose shuffle files go with them. Right for those that write a table: nothing else reads their shuffles, and a job of several of them holds one's at a time."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts the lineage: later jobs read the files, so neither a lost executor nor
    a second consumer runs the work before it again. The table stays until the
    shared folder is cleaned, or to the end of the ``scratch`` around the call.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` stored as a table that is dealt by ``key``: what groups by it reads its files in place and shuffles nothing.

    The table's name is the session's; its files lie where those of ``stored`` do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    df.write.bucketBy(shuffle_partitions(spark), key).option("path", path).saveAsTable(_table_name(path))
    return spark.table(_table_name(path))


#: One part in so many of all rows makes a key hot, so there are fewer hot keys than that.
HOT = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: Column) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per key; rows without a match go.

    The keys that ``hot`` marks, which must be those of more than one in ``HOT``
    of some rows, are few whatever the data, and meet their rows where those
    are; the others meet theirs by a shuffle, so no task gets a hot
    key's rows to itself. Both should be tables in files.
    """
    few = F.broadcast(table.where(hot))
    many = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot), key)
    return rows.join(few, key).unionByName(many)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Words of a text, in order, as a native array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows, so that few texts are Python objects at a time. At the end Arrow lets go of what it keeps for more."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
